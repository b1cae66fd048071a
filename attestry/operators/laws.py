"""Law mining over recorded calls.

obs(fn, case_id, self, args ARRAY<STRING>, heap, heap_after, tag, value, label): values are canonical JSON texts
`[kind, payload]`. Each law is tested on the observation table itself; a law nothing can testify for is
`not_checked`, never a pass. Laws about f(f x) or f(b, a) need partner rows, found by equi-joins on the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.ast_tables import KEY, identified
from attestry.functions.numeric import INT

LAWS = "fn STRING, law STRING, testified BIGINT, counterexamples BIGINT, holes BIGINT, uncovered BIGINT"
MIN_DOMAIN = 3


def int_payload(value):
    """The integer inside `["int", n]`, NULL for any other kind."""
    return F.regexp_extract(value, r'^\["int",\s*(-?\d+)\]$', 1).try_cast(INT)


def _row_laws(obs: DataFrame) -> DataFrame:
    value, tag = F.col("value"), F.col("tag")
    ran = tag.isin("val", "exn")
    first = F.try_element_at("args", F.lit(1))
    return obs.select(
        "fn",
        (tag == "hole").alias("hole"),
        ran.alias("runs"),
        (tag == "val").alias("returns"),
        F.coalesce(F.col("heap_after").eqNullSafe(F.col("heap")), F.lit(False)).alias("heappure"),
        F.coalesce((tag == "val") & (int_payload(value) >= 0), F.lit(False)).alias("nonneg"),
        F.when(first.isNotNull(), F.coalesce((tag == "val") & (value == first), F.lit(False))).alias("identity"),
        F.when(tag == "val", value).alias("val"),
        F.when(tag == "exn", value).alias("exn"),
    )


def row_laws(obs: DataFrame) -> DataFrame:
    """runs, returns, heappure, nonneg, identity, const, raises in one aggregation, one row per (fn, law)."""
    simple = ["runs", "returns", "heappure", "nonneg", "identity"]
    flags = _row_laws(obs)
    grouped = flags.groupBy("fn").agg(
        F.count("*").alias("n"),
        F.count_if("hole").alias("holes"),
        *[F.count(c).alias(f"{c}_n") for c in simple],
        *[F.count_if(~F.col(c)).alias(f"{c}_bad") for c in simple],
        F.count("val").alias("val_n"), F.min("val").alias("val_min"), F.max("val").alias("val_max"),
        F.count("exn").alias("exn_n"), F.min("exn").alias("exn_min"), F.max("exn").alias("exn_max"),
    )
    constant = (F.col("val_n") > 0) & (F.col("val_min") == F.col("val_max"))
    raising = (F.col("exn_n") > 0) & (F.col("val_n") == 0) & (F.col("exn_min") == F.col("exn_max"))
    # `const` and `raises` are proposed only where the recorded values suggest them; then every row is put to them.
    rows = [(c, F.col(f"{c}_n"), F.col(f"{c}_bad")) for c in simple]
    rows.append(("const", F.when(constant, F.col("n")).otherwise(0), F.when(constant, F.col("n") - F.col("val_n")).otherwise(0)))
    rows.append(("raises", F.when(raising, F.col("n")).otherwise(0), F.when(raising, F.col("n") - F.col("exn_n")).otherwise(0)))
    entries = F.array(*[
        F.struct(F.lit(law).alias("law"), n.alias("testified"), bad.alias("counterexamples")) for law, n, bad in rows
    ])
    return grouped.select("fn", "holes", F.explode(entries).alias("e")).select(
        "fn", "e.law", "e.testified", "e.counterexamples", "holes", F.lit(0).cast("bigint").alias("uncovered")
    )


def law_conform(obs: DataFrame, answers: DataFrame) -> DataFrame:
    """Recorded against candidate outcome on every distinct input; answers(case_id, tag, value)."""
    inputs = obs.groupBy("fn", "self", "heap", "args").agg(F.min_by(F.struct("case_id", "tag", "value"), "case_id").alias("o"))
    got = answers.select(F.col("case_id"), F.col("tag").alias("got_tag"), F.col("value").alias("got_value"))
    joined = inputs.select("fn", "o.case_id", "o.tag", "o.value").join(got, "case_id", "left")
    same = (F.col("tag") == F.col("got_tag")) & F.col("value").eqNullSafe(F.col("got_value"))
    return joined.groupBy("fn").agg(
        F.lit("conform").alias("law"),
        F.count("got_tag").alias("testified"),
        F.count_if(F.col("got_tag").isNotNull() & ~same).alias("counterexamples"),
        F.count_if(F.col("got_tag") == "hole").alias("holes"),
        F.count_if(F.col("got_tag").isNull()).alias("uncovered"),
    )


def _key(self_value, heap, args):
    return F.to_json(F.struct(self_value.alias("s"), heap.alias("h"), args.alias("a")))


def _inputs(obs: DataFrame) -> DataFrame:
    """One outcome per input, or none where two recordings disagree: such an input cannot testify."""
    outcome = F.to_json(F.struct("tag", "value", "label"))
    return (
        obs.groupBy("fn", _key(F.col("self"), F.col("heap"), F.col("args")).alias("key"))
        .agg(F.min(outcome).alias("lo"), F.max(outcome).alias("hi"), F.first("tag").alias("p_tag"), F.first("value").alias("p_value"))
        .where(F.col("lo") == F.col("hi"))
        .drop("lo", "hi")
    )


def _partner_law(obs: DataFrame, law: str, wanted, expected, applies) -> DataFrame:
    """Rows of one shape are counted once per (partner input, expectation) before the join, so hot values are one row."""
    weighed = (
        obs.where(applies)
        .groupBy("fn", wanted.alias("key"), expected.alias("expected"))
        .agg(F.count("*").alias("w"))
    )
    joined = weighed.join(_inputs(obs), ["fn", "key"], "left")
    found = F.col("p_tag").isNotNull()
    same = F.coalesce(F.to_json(F.struct(F.col("p_tag").alias("t"), F.col("p_value").alias("v"))) == F.col("expected"), F.lit(False))
    weigh = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("w"))), F.lit(0))
    return joined.groupBy("fn").agg(
        F.lit(law).alias("law"),
        weigh(found).alias("testified"),
        weigh(found & ~same).alias("counterexamples"),
        weigh(F.col("p_tag") == "hole").alias("holes"),
        weigh(~found).alias("uncovered"),
    )


def _outcome(tag, value):
    return F.to_json(F.struct(tag.alias("t"), value.alias("v")))


def _not_a_value(obs: DataFrame, law: str, needs_args: int) -> DataFrame:
    """Rows that returned no value refute f(f x) laws outright: there is nothing to apply f to again."""
    bad = F.col("tag") != "val"
    return obs.where(F.size("args") >= needs_args).groupBy("fn").agg(
        F.lit(law).alias("law"), F.count_if(bad).alias("testified"), F.count_if(bad).alias("counterexamples"),
        F.count_if(F.col("tag") == "hole").alias("holes"), F.lit(0).cast("bigint").alias("uncovered"),
    )


def _merged(*parts: DataFrame) -> DataFrame:
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("fn", "law").agg(*[F.sum(c).alias(c) for c in ("testified", "counterexamples", "holes", "uncovered")])


def law_idempotent(obs: DataFrame) -> DataFrame:
    """f(f x) = f x: the partner is the call whose only argument is the result, on the heap the first call left."""
    wanted = _key(F.col("self"), F.col("heap_after"), F.array("value"))
    partner = _partner_law(obs, "idempotent", wanted, _outcome(F.lit("val"), F.col("value")), F.col("tag") == "val")
    return _merged(partner, _not_a_value(obs, "idempotent", 0))


def law_involutive(obs: DataFrame) -> DataFrame:
    """f(f x) = x."""
    wanted = _key(F.col("self"), F.col("heap_after"), F.array("value"))
    first = F.try_element_at("args", F.lit(1))
    applies = (F.col("tag") == "val") & (F.size("args") >= 1)
    partner = _partner_law(obs, "involutive", wanted, _outcome(F.lit("val"), first), applies)
    return _merged(partner, _not_a_value(obs, "involutive", 1))


def law_commutes(obs: DataFrame) -> DataFrame:
    """f(a, b, ...) = f(b, a, ...): the partner has the first two arguments swapped and all else equal."""
    a, b = F.try_element_at("args", F.lit(1)), F.try_element_at("args", F.lit(2))
    rest = F.slice("args", F.lit(3), F.greatest(F.size("args") - 2, F.lit(0)))
    wanted = _key(F.col("self"), F.col("heap"), F.concat(F.array(b, a), rest))
    expected = _outcome(F.col("tag"), F.col("value"))
    return _partner_law(obs, "commutes", wanted, expected, F.size("args") >= 2)


def law_projects(obs: DataFrame, max_fields: int | None = None) -> DataFrame:
    """Result equals a field of the receiver, for all fields or the first by name; obs carries fields MAP<STRING,STRING>."""
    fields = obs.select("fn", F.explode(F.map_keys("fields")).alias("field")).distinct()
    if max_fields is not None:
        place = F.row_number().over(Window.partitionBy("fn").orderBy("field"))
        fields = fields.withColumn("r", place).where(F.col("r") <= max_fields).drop("r")
    tested = obs.join(fields, "fn").select("fn", "tag", "value", "fields", "field")
    holds = (F.col("tag") == "val") & (F.col("value") == F.try_element_at("fields", F.col("field")))
    return tested.groupBy("fn", "field").agg(
        F.count("*").alias("testified"),
        F.count_if(~F.coalesce(holds, F.lit(False))).alias("counterexamples"),
        F.count_if(F.col("tag") == "hole").alias("holes"),
    ).select(
        "fn", F.concat(F.lit("projects:"), "field").alias("law"), "testified", "counterexamples", "holes",
        F.lit(0).cast("bigint").alias("uncovered"),
    )


def body_laws(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bodies that, past their docstring, are `return literal` or, without parameters, `return self.f`."""
    root = nodes.where(F.col("body_root") & (F.col("k") == "ret")).select(*KEY, F.col("node_id").alias("root_id"))
    shape = F.col("k").isin("int", "str", "bool") | ((F.col("k") == "field") & (F.col("recv") == "self"))
    child = nodes.where(shape & (F.col("role") == "e")).select(*KEY, F.col("parent_id").alias("root_id"), "k", "name", "v")
    params = identified(functions, F.size(F.coalesce("params", F.array())).alias("n_params"))
    found = root.join(child, [*KEY, "root_id"]).join(params, KEY)
    constant = F.col("k") != "field"
    return found.where(constant | (F.col("n_params") == 0)).select(
        *KEY, F.when(constant, "constant_body").otherwise("accessor_body").alias("law"),
        F.when(constant, F.col("v")).otherwise(F.col("name")).alias("detail"),
    )


def refute(candidates: DataFrame) -> DataFrame:
    """Holes make a law inconclusive and so refuted; a counterexample refutes it; no testimony leaves it unchecked."""
    status = (
        F.when(F.col("testified") == 0, "not_checked")
        .when((F.col("holes") > 0) | (F.col("counterexamples") > 0), "refuted")
        .otherwise("candidate")
    )
    reason = (
        F.when(F.col("testified") == 0, "no row can testify")
        .when(F.col("holes") > 0, F.concat_ws("", F.lit("inconclusive: hole on "), F.col("holes"), F.lit(" rows")))
        .when(F.col("counterexamples") > 0, "counterexample in the domain")
    )
    return candidates.withColumn("status", status).withColumn("reason", reason)


def argument_reads(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Does the body read its first, its first two, all of its parameters? Any node whose value is the parameter's name counts."""
    params = identified(functions, "params").select(*KEY, F.posexplode("params").alias("at", "v"))
    read = nodes.where(F.col("v").isNotNull()).select(*KEY, "v").distinct().withColumn("reads", F.lit(True))
    hit = F.coalesce("reads", F.lit(False))
    return params.join(read, [*KEY, "v"], "left").groupBy(*KEY).agg(
        F.bool_and(F.when(F.col("at") == 0, hit)).alias("reads_first"),
        F.bool_and(F.when(F.col("at") <= 1, hit)).alias("reads_first_two"),
        F.bool_and(hit).alias("reads_all"),
    )


def screen_vacuous(candidates: DataFrame, min_domain: int = MIN_DOMAIN) -> DataFrame:
    """First vacuity that applies to a surviving candidate; universal laws are screened by construction.

    candidates(kind, domain, dom_kind, argument_insensitive, structurally_trivial, mentions_subject, status, reason).
    """
    live = (F.col("status") == "candidate") & (F.col("kind") != "universal")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    why = (
        F.when(F.col("kind") == "determinism", "reflexive_conclusion")
        .when(F.col("domain") == 0, "empty_quantification: no domain")
        .when(flag("argument_insensitive"), "argument_insensitive")
        .when(flag("structurally_trivial"), "trivial_conclusion")
        .when(~F.coalesce("mentions_subject", F.lit(True)), "dependency_vacuity")
        .when((F.col("dom_kind") == "case") & (F.col("domain") < min_domain), "empty_quantification: domain too small")
    )
    why = F.when(live, why)
    return candidates.withColumn("reason", F.coalesce(why, F.col("reason"))).withColumn(
        "status", F.when(why.isNotNull(), "vacuous").otherwise(F.col("status"))
    )


def characterize(obs: DataFrame, candidates: DataFrame, minimum: int = MIN_DOMAIN) -> DataFrame:
    """Pinned results of each subject with a surviving law, where enough ran. Recorded by the subject itself."""
    alive = candidates.where(F.col("status") == "candidate").select("fn").distinct()
    pinned = obs.where(F.col("tag").isin("val", "exn")).join(alive, "fn", "left_semi")
    enough = pinned.groupBy("fn").agg(F.count("*").alias("domain")).where(F.col("domain") >= minimum)
    return pinned.join(enough, "fn").select(
        "fn", "case_id", "args", "tag", "value", "domain", F.lit(True).alias("self_recorded")
    )


def law_report(candidates: DataFrame) -> DataFrame:
    """Per family and in total: candidates, refuted, vacuous, not checked, proved; vacuity over those considered."""
    proved = F.coalesce("proved", F.lit(False)) if "proved" in candidates.columns else F.lit(False)
    considered = F.col("candidates") - F.col("not_checked")
    return (
        candidates.withColumn("_proved", proved)
        .rollup("law")
        .agg(
            F.grouping("law").alias("g"),
            F.count("*").alias("candidates"),
            F.count_if(F.col("status") == "refuted").alias("refuted"),
            F.count_if(F.col("status") == "vacuous").alias("vacuous"),
            F.count_if(F.col("status") == "not_checked").alias("not_checked"),
            F.count_if("_proved").alias("proved"),
        )
        .select(
            F.when(F.col("g") == 1, "(all)").otherwise(F.col("law")).alias("family"), "candidates", "refuted", "vacuous",
            "not_checked", "proved",
            F.when(considered > 0, F.round(100.0 * F.col("vacuous") / F.nullif(considered, F.lit(0)), 1)).otherwise(0.0).alias("vacuity_pct"),
        )
    )


# The integer edges, and small pools for the other types.
INT_EDGES = [
    0, 1, -1, 2, -2, 7, -7, 10**6, 2**31 - 1, -(2**31), 2**31, 2**32, 2**63 - 1, -(2**63), 2**63, 10**18,
]
STR_EDGES = ["", "a", "key", "0"]


def param_types(name, n_params):
    """Types guessed from the signature text at the end of a name; `any` where the counts disagree."""
    inside = F.regexp_extract(name, r"\(([^()]*)\)\s*$", 1)
    raw = F.when(F.trim(inside) == "", F.array().cast("array<string>")).otherwise(F.split(inside, ",", -1))

    def guess(t):
        low = F.lower(t)
        return (
            F.when(t.contains("*"), "any")
            .when(low.contains("bool"), "bool")
            .when(low.rlike("int|long|short|size_t|unsigned|byte|word"), "int")
            .when(low.contains("string"), "str")
            .when(low.rlike("double|float"), "float")
            .otherwise("any")
        )

    unknown = F.transform(F.sequence(F.lit(1), F.greatest(n_params, F.lit(1))), lambda _: F.lit("any"))
    unknown = F.when(n_params > 0, unknown).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(raw) == n_params, F.transform(raw, guess)).otherwise(unknown)


def boundary_domain(signatures: DataFrame, n: int = 8, seed: int = 20260819) -> DataFrame:
    """Up to n distinct typed argument vectors per function, drawn from the edges by a seeded hash.

    The 4n attempts of a function are one array of its row, so only rows of functions are grouped, and the pool is never multiplied
    out. signatures(fn, n_params); arities of one name draw in turn.
    """
    ints = F.array(*[F.lit(f'["int",{i}]') for i in INT_EDGES])
    strs = F.array(*[F.lit(f'["str","{s}"]') for s in STR_EDGES])
    bools = F.array(F.lit('["bool",false]'), F.lit('["bool",true]'))
    every = F.concat(ints, strs, bools)

    def draw(t, i, j):
        pool = F.when(t == "int", ints).when(t == "str", strs).when(t == "bool", bools).otherwise(every)
        h = F.conv(F.substring(F.md5(F.concat_ws(":", "fn", i, j, F.lit(seed))), 1, 8), 16, 10).cast("bigint")
        return F.element_at(pool, (h % F.size(pool) + 1).cast("int"))

    attempts = F.sequence(F.lit(0), F.lit(4 * n - 1))
    vector = lambda i: F.transform("arities", lambda p: F.transform(param_types(F.col("fn"), p), lambda t, j: draw(t, i, j)))
    drawn = F.slice(F.array_distinct(F.flatten(F.transform(attempts, vector))), 1, n)
    # Small rows that mean much work: a number of tasks of its own, which adaptive execution doesn't merge by bytes.
    tasks = 4 * signatures.sparkSession.sparkContext.defaultParallelism
    named = signatures.select("fn", "n_params").repartition(tasks, "fn").groupBy("fn").agg(F.sort_array(F.collect_set("n_params")).alias("arities"))
    return named.select("fn", F.posexplode(drawn).alias("r", "args")).select("fn", (F.col("r") + 1).alias("case_no"), "args")


def fuel_guard(laws: DataFrame, answers: DataFrame, flags: DataFrame) -> DataFrame:
    """Per surviving law the cases that ran out of fuel; transportable only if none did and no try/finally is reached.

    answers(fn, law, tag, swapped_tag): `swapped_tag` is the second run a commuting law compares with, else NULL.
    """
    out = (F.col("tag") == "outOfFuel") | F.coalesce(F.col("swapped_tag") == "outOfFuel", F.lit(False))
    counted = answers.groupBy("fn", "law").agg(
        F.count_if(F.col("tag") == "outOfFuel").alias("out_of_fuel"),
        F.count_if(F.col("swapped_tag") == "outOfFuel").alias("out_of_fuel_swapped"),
        F.count_if(out).alias("blocked"),
    )
    tries = F.coalesce("has_try_finally", F.lit(False))
    reason = (
        F.when(tries, "subject reaches try/finally")
        .when(F.col("blocked").isNull(), "guard could not be evaluated")
        .when(F.col("blocked") > 0, "a case reached outOfFuel")
    )
    return (
        laws.where(F.col("status") == "candidate")
        .join(counted, ["fn", "law"], "left")
        .join(flags.select("fn", "has_try_finally"), "fn", "left")
        .select("fn", "law", "out_of_fuel", "out_of_fuel_swapped", reason.isNull().alias("transportable"), reason.alias("why_not"))
    )
