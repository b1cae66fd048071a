"""Assurance roll-up: claims whose status never exceeds the share of the population their evidence touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators.mutation import attributable
from attestry.operators.ranking import rank_in_group

# Statuses by rank; two of them share rank 0.
RANKS = {"UNDEVELOPED": 0, "DEFEATED": 0, "UNSUPPORTED": 1, "WEAK": 2, "SUPPORTED": 3}
BY_RANK = ["UNSUPPORTED", "WEAK", "SUPPORTED"]
COVERAGE_FULL, COVERAGE_WEAK = 1.0, 0.80


def rank(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), status)


def at_most(status: Column, cap: Column | str) -> Column:
    cap = F.lit(cap) if isinstance(cap, str) else cap
    return F.when(rank(status) <= rank(cap), status).otherwise(cap)


def coverage_cap(status: Column, covered: Column, population: Column) -> Column:
    """SUPPORTED needs the whole population, WEAK four fifths of it; with no population nothing is capped."""
    share = F.coalesce(covered, F.lit(0)) / F.nullif(population, F.lit(0))
    cap = F.when(share >= COVERAGE_FULL, "SUPPORTED").when(share >= COVERAGE_WEAK, "WEAK").otherwise("UNSUPPORTED")
    return F.when(F.coalesce(population, F.lit(0)) == 0, status).otherwise(at_most(status, cap))


def weakest_of(*statuses: Column) -> Column:
    """Conjunction of legs: the lowest rank, a refuted leg before an unexamined one."""
    low = F.least(*[rank(s) for s in statuses]) if len(statuses) > 1 else rank(statuses[0])
    defeated = statuses[0] == "DEFEATED"
    for s in statuses[1:]:
        defeated = defeated | (s == "DEFEATED")
    return _named(low, defeated)


def _named(low: Column, defeated: Column) -> Column:
    zero = F.when(defeated, "DEFEATED").otherwise("UNDEVELOPED")
    return F.when(F.coalesce(low, F.lit(0)) == 0, zero).otherwise(F.element_at(F.array(*map(F.lit, BY_RANK)), F.greatest(low, F.lit(1))))


def weakest(claims: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Weakest status per group; an empty group has none and is UNDEVELOPED wherever it is joined in."""
    return claims.groupBy(*by).agg(
        _named(F.min(rank(F.col(status))), F.coalesce(F.bool_or(F.col(status) == "DEFEATED"), F.lit(False))).alias(status)
    )


CLAIM = ["module", "id", "status", "evidence_kind", "covered", "population"]


def _claims(df: DataFrame, *rows: tuple) -> DataFrame:
    """rows of (id, status, evidence_kind, covered, population, applies) as claim rows of each module."""
    entries = [
        F.when(
            applies,
            F.struct(
                F.lit(i).alias("id"), status.alias("status"), kind.cast("string").alias("evidence_kind"),
                covered.cast("bigint").alias("covered"), population.cast("bigint").alias("population"),
            ),
        )
        for i, status, kind, covered, population, applies in rows
    ]
    return df.select("module", F.explode(F.array_compact(F.array(*entries))).alias("c")).select("module", "c.*")





def leg_faithfulness(conformance: DataFrame) -> DataFrame:
    """G2 and below: conformance(module, present, tag, total, agree, divergences, covered, population)."""
    z = lambda c: F.coalesce(c, F.lit(0))
    present, tag = F.col("present"), F.col("tag")
    off = present & tag.isNotNull() & (tag != F.col("module"))
    total, div = z("total"), z("divergences")
    base = (
        F.when(total == 0, "UNSUPPORTED").when(div > 0, "DEFEATED")
        .when(z("agree") >= total, "SUPPORTED").otherwise("UNSUPPORTED")
    )
    case = F.when(off, "UNDEVELOPED").when(tag.isNull(), at_most(base, "WEAK")).otherwise(base)
    covered = F.when(off, 0).otherwise(z("covered"))
    population = F.when(off, 0).otherwise(z("population"))
    rest = F.greatest(population - covered, F.lit(0))
    undeveloped = F.lit("UNDEVELOPED")
    # An off-subject run leaves only its own undeveloped leg, and no population to cap by.
    legs = F.when(rest > 0, weakest_of(case, undeveloped)).otherwise(case)
    g2 = F.when(~present, undeveloped).otherwise(coverage_cap(legs, covered, population))
    partial = (total > 0) & (population > 0) & (covered < population)
    test = F.lit("TEST")
    return _claims(
        conformance,
        ("G2", g2, F.when(present, test), covered, population, F.lit(True)),
        ("G2.1", case, test, covered, population, present & ~off),
        ("G2.2", undeveloped, F.lit(None), F.lit(0), rest, present & (rest > 0)),
        ("D1", F.lit("UNSUPPORTED"), F.lit(None), F.lit(None), F.lit(None), present & (total == 0)),
        ("D2", F.lit("UNSUPPORTED"), F.lit(None), F.lit(None), F.lit(None), present & partial),
    )


def leg_coverage(facts: DataFrame) -> DataFrame:
    """G3 and below. An execution result replaces the coverage proxy.

    facts(module, ast_present, functions, hole_free, holes, ledger_present, core, risk, exec_covered,
    oracle_present, claimed, survived, refuted): the ledger and oracle flags are false for off-subject evidence.
    """
    z = lambda c: F.coalesce(c, F.lit(0))
    ast, ledger, oracle = F.col("ast_present"), F.col("ledger_present"), F.col("oracle_present")
    functions, holes = z("functions"), z("holes")
    g3 = F.when(~ast, "UNDEVELOPED").when(holes == 0, "SUPPORTED").otherwise("UNSUPPORTED")
    core = F.when(ledger, z("core")).otherwise(z("hole_free"))
    core_status = F.when(core > 0, "SUPPORTED").otherwise("UNSUPPORTED")
    core_status = F.when(ledger, core_status).otherwise(weakest_of(core_status, F.lit("WEAK")))
    safe = ledger & F.coalesce(F.col("risk") == 0, F.lit(False))
    estimated = F.when(safe, "SUPPORTED").otherwise(coverage_cap(F.lit("WEAK"), z("exec_covered"), functions))
    claimed = F.when(z("claimed") == 0, functions).otherwise(F.col("claimed"))
    executed = F.when(z("survived") == claimed, "SUPPORTED").otherwise("DEFEATED")
    dynamic = F.when(oracle, executed).otherwise(estimated)
    static, test = F.lit("STATIC"), F.lit("TEST")
    return _claims(
        facts,
        ("G3", g3, F.lit(None), z("hole_free"), functions, F.lit(True)),
        ("G3.1", core_status, static, core, functions, ast),
        ("G3.2", dynamic, F.when(safe, static).otherwise(test), z("exec_covered"), functions, ast),
        ("D3", F.lit("UNSUPPORTED"), F.lit(None), F.lit(None), F.lit(None), ast & (dynamic != "SUPPORTED")),
        ("D3.1", F.lit("DEFEATED"), test, F.lit(None), F.lit(None), ast & oracle & (z("refuted") > 0)),
    )


def leg_contracts(contracts: DataFrame) -> DataFrame:
    """contracts(module, theorem, satisfiable, relative_to ARRAY<STRUCT<label, statement, fuelBound>>).

    A theorem is supported only if its environment is satisfiable, and the parent falls with any child.
    """
    short = F.element_at(F.split("theorem", "[.]", -1), -1)
    ok = F.coalesce("satisfiable", F.lit(False))
    children = contracts.where(F.col("theorem").isNotNull()).select(
        "module", F.concat(F.lit("G.CONTRACT."), short).alias("id"), F.when(ok, "SUPPORTED").otherwise("DEFEATED").alias("status")
    )
    parent = contracts.groupBy("module").agg(
        F.lit("G.CONTRACT").alias("id"),
        F.when(F.count("theorem") == 0, "UNDEVELOPED")
        .when(F.count_if(F.col("theorem").isNotNull() & ~ok) > 0, "DEFEATED")
        .otherwise("SUPPORTED")
        .alias("status"),
    )
    return children.unionByName(parent).withColumn("evidence_kind", F.lit("PROOF"))


def contract_assumptions(contracts: DataFrame) -> DataFrame:
    """Assumptions stay with the theorem that carries them; the same label elsewhere is not discharged by it."""
    short = F.element_at(F.split("theorem", "[.]", -1), -1)
    return contracts.select("module", short.alias("short"), "theorem", F.explode("relative_to").alias("a")).select(
        "module", F.regexp_replace(F.concat_ws(".", F.lit("A"), "short", "a.label"), " ", "-").alias("id"), "theorem",
        "a.label", "a.statement",
    )


def leg_adequacy(mutation: DataFrame) -> DataFrame:
    """G4: mutation(module, present, tag, killed, survived). Supported only when every mutant is killed."""
    killed, tried = F.coalesce("killed", F.lit(0)), F.coalesce("killed", F.lit(0)) + F.coalesce("survived", F.lit(0))
    usable = F.col("present") & attributable(F.coalesce("tag", F.lit("")), F.col("module"))
    status = (
        F.when(~usable | (tried == 0), "UNDEVELOPED").when(killed == tried, "SUPPORTED").otherwise("UNSUPPORTED")
    )
    return _claims(
        mutation,
        ("G4", status, F.when(usable, "TEST"), F.when(usable, killed).otherwise(0), F.when(usable, tried).otherwise(0), F.lit(True)),
    )


def leg_validity(axioms: DataFrame) -> DataFrame:
    """G5: axioms(module, present, axioms ARRAY<STRING>, leaks ARRAY<STRING>, theorems, repo_wide)."""
    present = F.col("present")
    none = F.array().cast("array<string>")
    bad = F.exists(F.coalesce("axioms", none), lambda a: F.contains(F.lower(a), F.lit("sorry"))) | (F.size(F.coalesce("leaks", none)) > 0)
    theorems = F.coalesce("theorems", F.lit(0))
    own = F.when(bad, "DEFEATED").when(theorems > 0, "SUPPORTED").otherwise("UNSUPPORTED")
    wide = F.coalesce("repo_wide", F.lit(False))
    g5 = F.when(~present, "UNDEVELOPED").when(wide & ~bad, at_most(own, "WEAK")).otherwise(own)
    proof = F.lit("PROOF")
    return _claims(
        axioms,
        ("G5", g5, F.when(present, proof), theorems, theorems, F.lit(True)),
        ("G5.1", own, proof, theorems, theorems, present & wide),
    )


LEGS = ["G2", "G3", "G4", "G5"]


def roll_up(claims: DataFrame, holes: DataFrame | None = None) -> DataFrame:
    """Top status per module with its blockers. Holes cap it at UNSUPPORTED, tested faithfulness at WEAK.

    claims as the legs give them, holes(module, holes). A leg nobody filled in counts as undeveloped.
    """
    legs = claims.where(F.col("id").isin(LEGS)).groupBy("module").agg(
        *[F.max(F.when(F.col("id") == leg, F.col("status"))).alias(leg) for leg in LEGS],
        F.max(F.when(F.col("id") == "G2", F.col("evidence_kind"))).alias("g2_kind"),
    )
    if holes is None:
        legs = legs.withColumn("holes", F.lit(0))
    else:
        legs = legs.join(holes.select("module", "holes"), "module", "left")
    holed = F.coalesce("holes", F.lit(0)) > 0
    tested = F.coalesce(F.col("g2_kind") == "TEST", F.lit(False))
    filled = [F.coalesce(leg, F.lit("UNDEVELOPED")) for leg in LEGS]
    top = weakest_of(*filled)
    top = F.when(holed, weakest_of(top, F.lit("UNSUPPORTED"))).otherwise(top)
    top = F.when(tested, weakest_of(top, F.lit("WEAK"))).otherwise(top)
    blockers = F.array_compact(
        F.array(
            F.when(holed, F.concat(F.col("holes").cast("string"), F.lit(" unresolved holes carried as assumptions"))),
            F.when(filled[0] != "SUPPORTED", "faithfulness not established over the whole module"),
            F.when(tested, "faithfulness is TESTED, not PROVED"),
        )
    )
    return legs.select(
        "module", *[s.alias(leg) for s, leg in zip(filled, LEGS)], top.alias("status"), (top == "SUPPORTED").alias("assertable"),
        blockers.alias("blockers"),
    )


def _typed_links(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """(module, id, kind, source), each once: evidence, counter_evidence, or defeaters for counters that are no evidence."""
    known = evidence.select("module", F.col("id").alias("source")).distinct().withColumn("is_evidence", F.lit(True))
    typed = links.join(known, ["module", "source"], "left")
    counters, is_evidence = F.col("type") == "COUNTERS", F.coalesce("is_evidence", F.lit(False))
    kind = F.when(~counters & is_evidence, "evidence").when(counters & is_evidence, "counter_evidence").when(counters, "defeaters")
    return typed.select("module", F.col("target").alias("id"), kind.alias("kind"), "source").where("kind IS NOT NULL").distinct()


def argument_claims(claims: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Per claim the numbers of its evidence, counter-evidence and defeaters, and whether it is undeveloped or defeated.

    claims(module, id, status), evidence(module, id), links(module, source, target, type).
    """
    kinds = ("evidence", "counter_evidence", "defeaters")
    counts = _typed_links(evidence, links).groupBy("module", "id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return claims.join(counts, ["module", "id"], "left").select(
        "module", "id", "status", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds],
        (F.col("status") == "UNDEVELOPED").alias("undeveloped"), (F.col("status") == "DEFEATED").alias("defeated"),
    )


def argument_edges(evidence: DataFrame, links: DataFrame, size: int = 1024) -> DataFrame:
    """(module, id, kind, block, sources): a claim's links of each kind in order, in numbered blocks of up to `size`.

    However many links a claim has, no array is longer, and its blocks are made by many tasks.
    """
    placed = rank_in_group(_typed_links(evidence, links), ["module", "id", "kind"], ["source"])
    blocks = placed.groupBy("module", "id", "kind", F.floor(F.col("rank") / size).alias("block"))
    return blocks.agg(F.sort_array(F.collect_list("source")).alias("sources"))


def assumptions(sites: DataFrame) -> DataFrame:
    """One named assumption per hole label, most frequent first: takes `ledger.hole_sites`."""
    return sites.select(
        "module", F.concat(F.lit("A."), F.regexp_replace("label", " ", "-")).alias("id"), "label",
        F.col("occurrences").alias("count"), "sites",
    ).orderBy(F.desc("count"), "id")


def subjects(files: DataFrame) -> DataFrame:
    """Name and digest of every present artifact: files(module, kind, path, content)."""
    return files.where(F.col("content").isNotNull()).select(
        "module", "kind", F.element_at(F.split("path", "/", -1), -1).alias("name"), F.sha2("content", 256).alias("sha256")
    )
