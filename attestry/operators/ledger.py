"""Ledgers and population aggregates. Every rate is a floor percent and says `n/a` where there is no population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import names
from attestry.operators import ast_tables, graph
from attestry.operators.ast_tables import KEY


def percent(part, whole) -> Column:
    """Floor percent as text, `n/a` over an empty population."""
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.when(whole == 0, "n/a").otherwise(
        F.concat(F.floor(part * 100 / F.nullif(whole, F.lit(0))), F.lit("%"))
    )


def tally(df: DataFrame, key: str, by: list[str] | None = None, top: int = 12) -> DataFrame:
    """Label counts, most frequent first, ties by label; one more row counts the labels left out.

    Ranking happens after counting, and the `rank <= top` limit is applied inside each task before the shuffle.
    """
    by = by or []
    counts = df.groupBy(*by, F.col(key).alias("label")).agg(F.count("*").alias("n"))
    left_out = (
        counts.groupBy(*by)
        .agg((F.count("*") - top).alias("n"))
        .where(F.col("n") > 0)
        .select(*by, F.lit(None).cast("string").alias("label"), "n", F.lit(top + 1).alias("rank"))
    )
    order = [F.desc("n"), F.asc("label")]
    if by:
        ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    else:
        kept = counts.orderBy(*order).limit(top)
        ranked = kept.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select(*by, "label", "n", "rank").unionByName(left_out)


def coverage_ledger(
    functions: DataFrame, facts: DataFrame, builtins: list[str] | None = None, dialects: DataFrame | None = None
) -> DataFrame:
    """Takes `ast_tables.function_facts`. Per module: functions, nodes, holes, hole-free, verifiable core, dynamic risk, dialect, and the rates."""
    dialects = dialects if dialects is not None else ast_tables.dialect_vote(functions)
    index = graph.resolve_index(functions).withColumnRenamed("key", "callee")
    counts = ["ledger_nodes", "holes", "risk"]
    zero = lambda c: F.lit(0).cast("bigint").alias(c)
    # One pass over the bodies: each function's counts travel on its first call, so nothing is read twice.
    called = (
        facts.select(*KEY, *counts, F.posexplode_outer("calls").alias("at", "c"))
        .select(
            *KEY, "c.is_method", "c.callee",
            *[F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c)).otherwise(0).alias(c) for c in counts],
        )
        .join(index, ["module", "callee"], "left")
        .join(dialects.select("module", "dialect"), "module", "left")
    )
    names_known = rules.BUILTIN_FREE_NAMES if builtins is None else builtins
    python = F.coalesce("dialect", F.lit("python")) == "python"
    answered = graph.answered(
        F.col("is_method"), F.col("is_name"), F.col("suffix_count"), F.col("callee").isin(names_known) & python
    )
    from_bodies = called.select(
        *KEY, zero("n_fn"), *counts, (F.col("callee").isNotNull() & ~answered).alias("leaks")
    )
    listed = ast_tables.identified(functions).select(
        *KEY, F.lit(1).cast("bigint").alias("n_fn"), *[zero(c) for c in counts],
        F.lit(False).alias("leaks"),
    )
    per_fn = (
        listed.unionByName(from_bodies)
        .groupBy(*KEY)
        .agg(*[F.sum(c).alias(c) for c in ["n_fn", *counts]], F.bool_or("leaks").alias("leaks"))
    )
    free = F.col("holes") == 0
    rolled = per_fn.groupBy("module").agg(
        F.sum("n_fn").alias("functions"),
        F.sum("ledger_nodes").alias("nodes"),
        F.sum("holes").alias("holes"),
        F.coalesce(F.sum(F.when(free, F.col("n_fn"))), F.lit(0)).alias("hole_free"),
        F.coalesce(F.sum(F.when(free & ~F.col("leaks"), F.col("n_fn"))), F.lit(0)).alias("verifiable_core"),
        F.sum("risk").alias("dynamic_risk"),
    )
    return rolled.join(dialects.select("module", "dialect"), "module", "left").select(
        "module", "dialect", "functions", "nodes", "holes", "hole_free", "verifiable_core", "dynamic_risk",
        percent("holes", "nodes").alias("holes_pct"),
        percent("hole_free", "functions").alias("hole_free_pct"),
        percent("verifiable_core", "functions").alias("core_pct"),
    )


def language_matrix(functions: DataFrame, facts: DataFrame) -> DataFrame:
    """Takes `ast_tables.function_facts`. Per corpus: leading extension, dialect, functions, nodes (matrix convention), holes and both rates."""
    stats = facts.select(*KEY, "matrix_nodes", "holes")
    per_fn = ast_tables.identified(functions).join(stats, KEY, "left")
    rolled = per_fn.groupBy("module").agg(
        F.count("*").alias("functions"),
        F.coalesce(F.sum("matrix_nodes"), F.lit(0)).alias("nodes"),
        F.coalesce(F.sum("holes"), F.lit(0)).alias("holes"),
        F.count_if(F.coalesce("holes", F.lit(0)) == 0).alias("hole_free"),
    )
    exts = (
        functions.select("module", names.extension(F.coalesce("file", F.lit(""))).alias("ext"))
        .groupBy("module", "ext")
        .agg(F.count("*").alias("n"))
        .groupBy("module")
        .agg(F.max_by("ext", F.struct("n", "ext")).alias("ext"))
    )
    share = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.nullif(b, F.lit(0))).otherwise(0.0)
    return (
        rolled.join(exts, "module")
        .join(ast_tables.dialect_vote(functions).select("module", "dialect"), "module")
        .select(
            "module", "ext", "dialect", "functions", "nodes", "holes", "hole_free",
            share("holes", "nodes").alias("hole_pct"), share("hole_free", "functions").alias("hole_free_pct"),
        )
    )


def hole_causes(holes: DataFrame, top: int = 15) -> DataFrame:
    """(module, label, n, rank): the most frequent causes of holes of each corpus, ties by label; what is left is one row without a label."""
    return tally(holes, "label", by=["module"], top=top)


def corpus_shape(functions: DataFrame, facts: DataFrame) -> DataFrame:
    """Takes `ast_tables.function_facts`. Per corpus: functions, all objects, deepest nesting, raw holes, bytes of body text."""
    shape = facts.groupBy("module").agg(F.sum("shape_nodes").alias("nodes"), F.max("max_depth").alias("max_depth"), F.sum("holes").alias("holes"))
    counts = functions.groupBy("module").agg(
        F.count("*").alias("functions"), F.sum(F.octet_length("body")).alias("bytes")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.join(shape, "module", "left").select(
        "module", "functions", zero("nodes"), zero("max_depth"), zero("holes"), "bytes"
    )


def hole_sites(holes: DataFrame, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """Per label: occurrences and the first k functions in corpus order, which `fn_pos` of the holes is."""
    by = by or ["module"]
    per_fn = holes.groupBy(*by, "label", "fn", "fn_pos").agg(F.count("*").alias("c"))
    totals = per_fn.groupBy(*by, "label").agg(F.sum("c").alias("occurrences"), F.count("*").alias("n_functions"))
    w = Window.partitionBy(*by, "label").orderBy("fn_pos", "fn")
    first = (
        per_fn.withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= k)
        .groupBy(*by, "label")
        .agg(F.sort_array(F.collect_list(F.struct("r", "fn"))).alias("s"))
        .select(*by, "label", F.col("s.fn").alias("sites"))
    )
    return totals.join(first, [*by, "label"])


def effect_histogram(effects: DataFrame) -> DataFrame:
    """Functions per effect class; the row with effect `pure` counts those with none."""
    return (
        effects.select("module", F.explode_outer("effects").alias("effect"))
        .groupBy("module", F.coalesce("effect", F.lit("pure")).alias("effect"))
        .agg(F.count("*").alias("n"))
    )


def stage_table(stages: DataFrame, stage_names: list[str]) -> DataFrame:
    """One row per target, a column per stage: seconds, FAIL, TIMEOUT, or a dash; plus the peak memory."""
    cell = (
        F.when(F.col("timed_out"), "TIMEOUT")
        .when(~F.col("ok"), "FAIL")
        .otherwise(F.format_string("%.0f", "seconds"))
    )
    peak = stages.groupBy("target").agg(F.max("peak_rss_mb").alias("peak_rss_mb"))
    wide = (
        stages.withColumn("cell", cell).groupBy("target").pivot("stage", stage_names).agg(F.first("cell"))
    )
    return wide.join(peak, "target").select(
        "target", *[F.coalesce(F.col(f"`{s}`"), F.lit("—")).alias(s) for s in stage_names], "peak_rss_mb"
    )


def empty_body_split(survivors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Survivors whose body does nothing against the rest; a body never seen is its own class."""
    key = [c for c in KEY if c in survivors.columns]
    empty = nodes.groupBy(*key).agg(
        F.bool_and(F.coalesce("k", F.lit("")).isin("skip", "seq")).alias("empty")
    )
    kind = F.when(F.col("empty").isNull(), "no_body").when(F.col("empty"), "empty").otherwise("substantive")
    return (
        survivors.select(*key)
        .join(empty, key, "left")
        .groupBy("module", kind.alias("body"))
        .agg(F.count("*").alias("n"))
    )


THEOREM_LINE = r"(?m)^\s*theorem "


def proved_inventory(modules: DataFrame, pattern: str = THEOREM_LINE) -> DataFrame:
    """modules(module, status, text): theorems in modules that checked against theorems merely counted in text."""
    counted = modules.select("module", "status", F.regexp_count("text", F.lit(pattern)).cast("bigint").alias("n"))
    ok = F.col("status") == "OK"
    return counted.agg(
        F.count("*").alias("modules"),
        F.count_if(ok).alias("modules_ok"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("proved"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("counted"),
    )
