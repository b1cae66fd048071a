"""Mutation evidence: mutants of node tables, attribution of build errors, scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators import ast_tables
from attestry.operators.ast_tables import KEY, identified
from attestry.operators.opened import Opened

# Swaps stay inside a class of operators so the mutant is a behavioural bug, not a syntax error.
BINOP_SWAPS = {
    "+": "-", "-": "+", "*": "+", "/": "*", "%": "/", "<": "<=", "<=": "<", ">": ">=", ">=": ">", "==": "!=",
    "!=": "==", "&&": "||", "||": "&&",
}
UNOP_SWAPS = {"-": "+", "!": "-", "~": "-"}
DELETABLE = ["assign", "setField", "exprS", "ret", "raise", "del", "setIndex"]
DECLARATION = (
    r"^\s*(?:@\[[^\]]*\]\s*)?(?:private\s+|protected\s+|partial\s+|noncomputable\s+|unsafe\s+)*"
    r"(theorem|lemma|example|def|abbrev|instance|inductive|structure|class)\b\s*([A-Za-z_][A-Za-z0-9_'!?.₀-₉]*)?"
)
THEOREM_KINDS = ["theorem", "lemma"]
DEFINITION_KINDS = ["def", "abbrev", "instance"]
ERROR_POSITION_FIRST = r"(?m)^(.*?):(\d+):(\d+):\s*error"
ERROR_SEVERITY_FIRST = r"(?m)^error:\s*(\S.*?):(\d+):(\d+):"
BUCKET_LINES = 1024


def _swap(table: dict[str, str], op):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), op)


def _mutant(op, old, new, when):
    return F.when(
        when, F.struct(F.concat_ws("", F.lit(op), old, F.lit("->"), new).alias("op"), old.cast("string").alias("before"), new.cast("string").alias("after"))
    )


def _alternates(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """Per function the two first names and two first fields in it: one of the two differs from any given one."""
    key = KEY
    params = identified(functions, "params").select(*key, F.posexplode("params").alias("at", "name")).select(
        *key, "name", F.lit("name").alias("pool"), (F.col("at") - 1_000_000).cast("bigint").alias("at")
    )
    kind = F.when(F.col("k") == "name", "name").when(F.col("k").isin("field", "setField"), "field")
    order = F.col("node_id") + F.when(F.col("k") == "setField", 1_000_000_000).otherwise(0).cast("bigint")
    inside = nodes.select(*key, "name", kind.alias("pool"), order.alias("at")).where(F.col("pool").isNotNull())
    firsts = params.unionByName(inside).groupBy(*key, "pool", "name").agg(F.min("at").alias("at"))
    w = Window.partitionBy(*key, "pool").orderBy("at")
    return (
        firsts.withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= 2)
        .groupBy(*key)
        .agg(
            *[
                F.max(F.when((F.col("pool") == p) & (F.col("r") == i), F.col("name"))).alias(f"{p}_{i}")
                for p in ("name", "field")
                for i in (1, 2)
            ]
        )
    )


def _rewrites():
    """The mutants of a node with the first names and fields of its function beside it."""
    k, op, name, v = F.col("k"), F.col("op"), F.col("name"), F.col("v")
    binop, unop = _swap(BINOP_SWAPS, op), _swap(UNOP_SWAPS, op)
    flipped = lambda c: F.when(F.lower(c) == "true", "false").otherwise("true")
    number = v.try_cast("decimal(38,0)")
    other = lambda pool: F.when(F.col(f"{pool}_1") != name, F.col(f"{pool}_1")).otherwise(F.col(f"{pool}_2"))
    field_alt = F.coalesce(other("field"), F.concat(name, F.lit("__mutated")))
    name_alt = other("name")
    return F.array_compact(
        F.array(
            _mutant("ast-binop:", op, binop, (k == "binop") & binop.isNotNull()),
            _mutant("ast-unop:", op, unop, (k == "unop") & unop.isNotNull()),
            _mutant("ast-polarity:", op, flipped(op), k.isin("isOp", "inOp")),
            _mutant("ast-", F.lit("ret"), F.lit("expr"), k == "ret"),
            _mutant("ast-", F.lit("expr"), F.lit("ret"), k == "exprS"),
            _mutant("ast-int:", v, (number + 1).cast("string"), (k == "int") & number.isNotNull()),
            _mutant("ast-int:", v, (number - 1).cast("string"), (k == "int") & number.isNotNull()),
            _mutant("ast-bool:", v, flipped(v), k == "bool"),
            _mutant("ast-field:", name, field_alt, k == "field"),
            _mutant("ast-setfield:", name, field_alt, k == "setField"),
            _mutant("ast-name:", name, name_alt, (k == "name") & name_alt.isNotNull()),
            _mutant("ast-assign:", name, name_alt, (k == "assign") & name_alt.isNotNull()),
            F.when(
                k.isin(DELETABLE),
                F.struct(F.lit("ast-seq-delete").alias("op"), k.alias("before"), F.lit("skip").alias("after")),
            ),
        )
    )


def generate_mutants(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """One row per applicable rewrite of a node. Replacement names and fields come from the same function."""
    found = _alternates(nodes, functions)
    found = found.select(F.struct(*KEY).alias("of"), *[c for c in found.columns if c not in KEY])
    return (
        nodes.join(found, F.struct(*[nodes[c] for c in KEY]).eqNullSafe(found["of"]), "left")  # a module may be null
        .select("module", F.col("fn").alias("decl"), "node_id", F.explode(_rewrites()).alias("m"))
        .select("module", "decl", "node_id", "m.op", "m.before", "m.after")
    )


# Kinds that a rewrite applies to; by these columns the rewrites tell nodes of one body apart.
REWRITTEN = ["binop", "unop", "isOp", "inOp", "int", "bool", "field", "setField", "name", *DELETABLE]
_ALIKE = ["module", "k", "op", "v", "name", "name_1", "name_2"]


def _nodes_to_rewrite(bodies: pa.Array) -> tuple[pa.Table, np.ndarray]:
    """(doc, k, op, v, name) of the nodes with these kinds in the order of their bodies, and the odd bodies, which have none here."""
    o = Opened(bodies)
    *values, other = o.values("v", numbers=True)
    o.odd_where((o.is_kind("name", "int", "bool") & other) | o.is_kind("isOp", "inOp"))
    names, assigned = [x.copy() for x in values], ast_tables._spans(o, o.is_kind("assign"), "x")
    names[0] &= o.is_kind("name")
    values[0] &= o.is_kind("int", "bool")
    for whole, part in zip(names, assigned):
        whole[assigned[0]] = part[assigned[0]]
    spans = {"k": o.kind[:3], "op": ast_tables._spans(o, o.is_kind("binop", "unop"), "op"), "v": values, "name": names}
    wanted = o.is_kind(*REWRITTEN) & ~o.odd[o.doc]
    texts = {c: o.texts(*(x[wanted] for x in span)) for c, span in spans.items()}
    return pa.table({"doc": pa.array(o.doc[wanted], pa.int64()), **texts}), o.odd


def _walked_to_rewrite(bodies: pa.Array, odd: np.ndarray) -> pa.Table:
    at = [ast_tables._WALK_COLUMNS.index(c) for c in ("k", "op", "v", "name")]
    rows = [(i, *(node[j] for j in at)) for i in np.flatnonzero(odd).tolist() for node in ast_tables._walk(ast_tables._decode(bodies[i].as_py()), frozenset(REWRITTEN))]
    columns = list(zip(*rows)) or [()] * 5
    return pa.table({c: pa.array(x, pa.string() if i else pa.int64()) for i, (c, x) in enumerate(zip(("doc", "k", "op", "v", "name"), columns))})


def _first_names(nodes: pa.Table, params: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Of each function the first name among its parameters and `name` nodes, and the first that differs from it.

    A name that is missing is one of its own, as it is to `_alternates`; it is told from no name at all by neither.
    """
    named = pc.equal(nodes["k"], "name").combine_chunks()
    owner, name = nodes["doc"].combine_chunks().filter(named), nodes["name"].combine_chunks().filter(named)
    of_params = pa.array(np.repeat(np.arange(len(params)), pc.fill_null(pc.list_value_length(params), 0).to_numpy()))
    owner = np.concatenate([of_params.to_numpy(), owner.to_numpy()]).astype(np.int64)
    names = pa.concat_arrays([params.flatten().cast(pa.string()), name])
    order = np.argsort(owner, kind="stable")
    owner, code = owner[order], pc.fill_null(names.dictionary_encode("encode").indices, -1).to_numpy()[order]
    place = [np.full(len(params), -1), np.full(len(params), -1)]
    held, first = np.unique(owner, return_index=True)
    start = np.zeros(len(params), np.int64)
    start[held] = first
    place[0][held] = order[first]
    differs = np.flatnonzero(code != code[start[owner]])
    held, second = np.unique(owner[differs], return_index=True)
    place[1][held] = order[differs[second]]
    return tuple(names.take(pa.array(p, mask=p < 0)) for p in place)


def _alike(piece: pa.RecordBatch) -> pa.Table:
    """How many nodes of a piece of a batch (module, body, params) are alike to the rewrites, names by their numbers in the body."""
    bodies, parts = pc.fill_null(piece.column(1), "{}"), []
    together, odd = _nodes_to_rewrite(bodies)
    for nodes in (together, _walked_to_rewrite(bodies, odd)) if odd.any() else (together,):
        nodes = nodes.combine_chunks()
        owner = nodes["doc"].combine_chunks()
        firsts = [names.take(owner) for names in _first_names(nodes, piece.column(2))]
        k, name = nodes["k"].combine_chunks(), nodes["name"].combine_chunks()
        missing, none = pa.scalar(None, pa.string()), pa.nulls(len(k), pa.string())
        only = lambda kinds, c: pc.if_else(pc.fill_null(pc.is_in(k, pa.array(kinds)), False), c, none)
        number = lambda c, n: pc.if_else(c.is_valid(), n, missing)
        same = pc.fill_null(pc.equal(name, firsts[0]), False)
        parts.append(pa.table({
            "module": piece.column(0).cast(pa.string()).take(owner), "k": k, "op": only(["binop", "unop", "isOp", "inOp"], nodes["op"].combine_chunks()),
            "v": only(["int", "bool"], nodes["v"].combine_chunks()), "name": only(["name", "assign"], number(name, pc.if_else(same, "1", "2"))),
            "name_1": number(firsts[0], "1"), "name_2": number(firsts[1], "2"),
        }))
    return pa.concat_tables(parts).group_by(_ALIKE, use_threads=False).aggregate([([], "count_all")])


def _alike_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in ast_tables._pieces(batch, 1) if batch.num_rows else ():
            yield from _alike(piece).rename_columns([*_ALIKE, "n"]).combine_chunks().to_batches()


def count_mutants(functions: DataFrame) -> DataFrame:
    """(module, family, n): how many mutants `generate_mutants` makes, by the text of their `op` before a colon.

    The same rewrites, applied once to nodes that are alike: their number doesn't hang on what a name is, only on which names of a
    body are the same, nor on fields, which always have a replacement.
    """
    counted = functions.select("module", "body", "params").mapInArrow(_alike_batches, ", ".join(f"{c} STRING" for c in _ALIKE) + ", n BIGINT")
    alike = counted.groupBy(*_ALIKE).agg(F.sum("n").alias("n"))
    no_field = F.lit(None).cast("string")
    mutants = alike.select("*", no_field.alias("field_1"), no_field.alias("field_2")).select("module", "n", F.explode(_rewrites()).alias("m"))
    return mutants.groupBy("module", F.split("m.op", ":", -1).getItem(0).alias("family")).agg(F.sum("n").alias("n"))


def decl_ranges(lines: DataFrame, bucket: int = BUCKET_LINES) -> DataFrame:
    """Declarations with 1-based inclusive line ranges: lines(file, line, text).

    The next declaration is looked up inside a block of lines and only then across blocks, so a file holding most of
    the lines is cut over many tasks.
    """
    kind, name = F.regexp_extract("text", DECLARATION, 1), F.regexp_extract("text", DECLARATION, 2)
    decls = lines.where(kind != "").select(
        "file", F.col("line").alias("start"), kind.alias("kind"),
        F.when(name == "", F.format_string("<anon@%d>", "line")).otherwise(name).alias("name"),
    )
    return close_ranges(decls, lines.groupBy("file").agg(F.max("line").alias("last")), bucket)


def close_ranges(decls: DataFrame, lasts: DataFrame, bucket: int = BUCKET_LINES) -> DataFrame:
    """End of each (file, start, ...): one before the next start in its file, or the file's last line."""
    block = F.floor(F.col("start") / bucket)
    blocked = decls.withColumn("block", block)
    inside = blocked.withColumn(
        "next", F.lead("start").over(Window.partitionBy("file", "block").orderBy("start"))
    )
    firsts = blocked.groupBy("file", "block").agg(F.min("start").alias("first"))
    following = firsts.withColumn("next_block", F.lead("first").over(Window.partitionBy("file").orderBy("block")))
    return (
        inside.join(following.drop("first"), ["file", "block"], "left")
        .join(lasts, "file", "left")
        .withColumn("end", F.coalesce(F.coalesce("next", "next_block") - 1, F.col("last")))
        .drop("block", "next", "next_block", "last")
    )


def error_positions(diagnostics: DataFrame) -> DataFrame:
    """(run columns, file base name, line) of every error in both diagnostic layouts: diagnostics(mutant_id, output)."""

    def layout(pattern: str) -> DataFrame:
        files = F.regexp_extract_all("output", F.lit(pattern), 1)
        at = F.regexp_extract_all("output", F.lit(pattern), 2)
        return diagnostics.select("mutant_id", F.explode(F.arrays_zip(files.alias("f"), at.alias("l"))).alias("e"))

    both = layout(ERROR_POSITION_FIRST).unionByName(layout(ERROR_SEVERITY_FIRST))
    return both.select(
        "mutant_id", F.element_at(F.split(F.trim("e.f"), "/", -1), -1).alias("file"), F.col("e.l").cast("int").alias("line")
    ).distinct()


def in_range(points: DataFrame, ranges: DataFrame, bucket: int = BUCKET_LINES) -> DataFrame:
    """Each (file, line) with the range (file, start, end) that holds it, if any.

    A range is laid over the blocks of lines it touches and a point over its one block, so the join is on equality
    and a block never pairs more than its own lines' worth of ranges.
    """
    laid = ranges.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)))
    )
    placed = points.withColumn("block", F.floor(F.col("line") / bucket))
    held = (placed["line"] >= laid["start"]) & (placed["line"] <= laid["end"])
    same = (placed["file"] == laid["file"]) & (placed["block"] == laid["block"])
    rest = [laid[c] for c in laid.columns if c not in ("file", "block")]
    return placed.join(laid, same & held, "left").select(*[placed[c] for c in points.columns], *rest)


def attribute_errors(diagnostics: DataFrame, decls: DataFrame) -> DataFrame:
    """Errors with the declaration they fall in; `kind` is NULL for an error on no declaration."""
    return in_range(error_positions(diagnostics), decls).select("mutant_id", "file", "line", "kind", "name")


def judge_mutants(runs: DataFrame, errors: DataFrame, base: str, spec_base: str) -> tuple[DataFrame, DataFrame]:
    """What each run says of all theorems, and which it names.

    runs(mutant_id, rc, timed_out), errors from `attribute_errors`. The first result has one row for each mutant: state (scored,
    invalid, inconclusive), kills_all (it timed out, or failed without an error of its own), coarse and pin_only. The second has
    the (mutant_id, theorem) of errors in theorems. Every verdict follows from the two, so no table of mutants by theorems is made.
    """
    mine, spec = F.col("file") == base, F.col("file") == spec_base
    theorem = spec & F.col("kind").isin(THEOREM_KINDS)
    per_run = errors.groupBy("mutant_id").agg(
        F.count_if(mine).alias("own"), F.count_if(spec).alias("in_spec"), F.count_if(~mine & ~spec).alias("foreign"),
        F.count_if(mine & F.col("kind").isin(DEFINITION_KINDS)).alias("hit_defs"), F.count_if(theorem & F.col("name").isNotNull()).alias("n_hits"),
    )
    hits = errors.where(theorem & F.col("name").isNotNull()).select("mutant_id", F.col("name").alias("theorem")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0))
    failed, nowhere = F.col("rc") != 0, (zero("own") == 0) & (zero("in_spec") == 0)
    state = (
        F.when(failed & nowhere & (zero("foreign") > 0), "inconclusive")
        .when(failed & (zero("hit_defs") > 0) & (zero("n_hits") == 0), "invalid")
        .otherwise("scored")
    )
    scored, coarse = F.col("state") == "scored", failed & nowhere
    judged = runs.join(per_run, "mutant_id", "left").withColumn("state", state).select(
        "mutant_id", "state", (F.coalesce("timed_out", F.lit(False)) | coarse).alias("kills_all"), (coarse & scored).alias("coarse"),
        ((zero("in_spec") > 0) & (zero("n_hits") == 0) & scored).alias("pin_only"),
    )
    return judged, hits


def classify_mutants(judged: DataFrame, hits: DataFrame, asked: DataFrame) -> DataFrame:
    """Verdict of each asked (mutant_id, theorem): inconclusive, invalid, killed or survived, with coarse and pin-only marked."""
    named = hits.withColumn("hit", F.lit(True))
    each = asked.select("mutant_id", "theorem").join(judged, "mutant_id").join(named, ["mutant_id", "theorem"], "left")
    dead = F.coalesce("hit", F.lit(False)) | F.col("kills_all")
    verdict = F.when(F.col("state") != "scored", F.col("state")).when(dead, "killed").otherwise("survived")
    return each.select("mutant_id", "theorem", verdict.alias("verdict"), "coarse", "pin_only")


def mutation_score(judged: DataFrame, hits: DataFrame, mutants: DataFrame, targets: DataFrame, subject_map: DataFrame) -> DataFrame:
    """Per theorem of targets(theorem): killed, survived, score and verdict, on its subject where subject_map(theorem, decl) has one.

    mutants(mutant_id, decl). Counting is by complement: of a declaration's scored mutants those survive a theorem that neither
    kill all theorems nor name it, so counts by declaration and the hits are enough. Invalid and inconclusive mutants stay out of
    every count, but a theorem that has no other ones keeps its row.
    """
    scored = judged.where("state = 'scored'").join(mutants.select("mutant_id", "decl"), "mutant_id")
    by_decl = scored.groupBy("decl").agg(F.count("*").alias("scored"), F.count_if("kills_all").alias("dead"))
    named = hits.join(scored.where("NOT kills_all"), "mutant_id").groupBy("theorem", "decl").agg(F.count("*").alias("named"))
    everywhere = by_decl.agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("all_scored"), F.coalesce(F.sum("dead"), F.lit(0)).alias("all_dead"))
    pairs = subject_map.select("theorem", "decl").distinct()
    mine = pairs.join(by_decl, "decl", "left").join(named, ["theorem", "decl"], "left").groupBy("theorem").agg(
        F.coalesce(F.sum("scored"), F.lit(0)).alias("own_scored"), (F.coalesce(F.sum("dead"), F.lit(0)) + F.coalesce(F.sum("named"), F.lit(0))).alias("own_killed")
    )
    kills = named.groupBy("theorem").agg(F.sum("named").alias("named"))
    totals = everywhere.first()
    each = targets.select("theorem").distinct().join(mine.withColumn("mapped", F.lit(True)), "theorem", "left").join(kills, "theorem", "left")
    mapped = F.coalesce("mapped", F.lit(False))
    all_killed = F.coalesce("named", F.lit(0)) + totals.all_dead
    killed = F.when(mapped, F.col("own_killed")).otherwise(all_killed)
    tried = F.when(mapped, F.col("own_scored")).otherwise(F.lit(totals.all_scored))
    score = F.when(F.col("tried") > 0, F.col("killed") / F.nullif("tried", F.lit(0))).otherwise(0.0)
    verdict = F.when(F.col("mapped") & (F.col("tried") == 0), "UNTESTED").when(score == 1.0, "HAS TEETH").when(score > 0, "WEAK").otherwise("VACUOUS")
    share = F.coalesce(all_killed / F.nullif(F.lit(totals.all_scored), F.lit(0)), F.lit(0.0))
    counts = each.select("theorem", mapped.alias("mapped"), killed.alias("killed"), tried.alias("tried"), share.alias("coverage_score"))
    return counts.select(
        "theorem", "killed", (F.col("tried") - F.col("killed")).alias("survived"), score.alias("score"), "coverage_score",
        F.when(F.col("mapped"), "on-subject").otherwise("all-mutants").alias("scope"), verdict.alias("verdict"),
    )


def survivors_on_subject(judged: DataFrame, hits: DataFrame, mutants: DataFrame, subject_map: DataFrame) -> DataFrame:
    """(mutant_id, theorem, decl): surviving mutants of a theorem's own subject, met by declaration."""
    alive = judged.where("state = 'scored' AND NOT kills_all").select("mutant_id").join(mutants.select("mutant_id", "decl"), "mutant_id")
    met = alive.join(subject_map.select("theorem", "decl").distinct(), "decl")
    return met.join(hits, ["mutant_id", "theorem"], "left_anti").select("mutant_id", "theorem", "decl")


def attributable(tag, module):
    """A score counts only for a module its tag names, case aside."""
    return F.coalesce((tag != "") & F.contains(F.lower(tag), F.lower(module)), F.lit(False))
