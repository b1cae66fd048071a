"""Recomputed-value audit: recorded (op, args, result) rows against the same operation recomputed natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import numeric
from attestry.functions import values as V

RELATIONS = ["<", "<=", ">", ">=", "==", "!="]


def audit_values(obs: DataFrame) -> DataFrame:
    """obs(op, config, a_kind, a, b_kind, b, result_tag, result) plus any other columns, which are kept.

    Adds outcome (ok, divZero, ub, trap, unrepresentable, unmodelled), the recomputed value as text, and a verdict.
    `ub`, `unrepresentable` and `unmodelled` are inconclusive: nothing was compared.
    """
    spark = obs.sparkSession
    op, ak, a, bk, b = (F.col(c) for c in ("op", "a_kind", "a", "b_kind", "b"))
    python = F.col("config") == "python"
    unary = op.isin("neg", "~") | op.startswith("cast:")
    boolean_cast = op.startswith("cast:") & (ak == "bool")
    x = F.when(boolean_cast, V.int_value(ak, a)).otherwise(V.as_int(a))
    ints = ((ak == "int") & (unary | (bk == "int"))) | boolean_cast
    floats = (ak == "float") & (bk.isin("int", "float")) | ((ak == "int") & (bk == "float"))
    number = numeric.apply_int(op, x, F.when(unary, numeric.whole(0)).otherwise(V.as_int(b)))
    fraction = V.float_arithmetic(op, V.as_float(a), V.as_float(b), python)
    related = V.relation(op, ak, a, bk, b, python)
    conn = F.when(op == "&&", ~V.truthy(ak, a)).otherwise(V.truthy(ak, a))
    operand = F.when(conn, a).otherwise(b)
    both = F.when(op == "&&", V.truthy(ak, a) & V.truthy(bk, b)).otherwise(V.truthy(ak, a) | V.truthy(bk, b))
    same = V.identical(ak, a, bk, b)
    text = lambda c: c.cast("string")
    joined = obs.join(numeric.configs(spark), "config", "left")
    recomputed = (
        F.when(op.isin(RELATIONS), _maybe(text(related)))
        .when(op == "is", _maybe(text(same)))
        .when(op.isin("&&", "||"), _maybe(F.when(python & ~floats, operand).otherwise(text(both))))
        .when(ints, F.struct(F.coalesce(number["outcome"], F.lit("unmodelled")).alias("outcome"), text(number["value"]).alias("value")))
        .when(floats, F.struct(fraction["outcome"].alias("outcome"), text(fraction["value"]).alias("value")))
        .when((op == "+") & (ak == "str") & (bk == "str") & python, _maybe(F.concat(a, b)))
        .otherwise(_maybe(F.lit(None).cast("string")))
    )
    compared = joined.withColumn("_r", recomputed).select(
        *[obs[c] for c in obs.columns], F.col("_r.outcome").alias("outcome"), F.col("_r.value").alias("recomputed")
    )
    raised = F.when(F.col("outcome") == "divZero", "ZeroDivisionError")
    agrees = F.when(
        F.col("outcome") == "ok", (F.col("result_tag") == "val") & F.col("result").eqNullSafe(F.col("recomputed"))
    ).otherwise((F.col("result_tag") == "exn") & F.coalesce(F.col("result") == raised, F.lit(True)))
    comparable = F.col("outcome").isin("ok", "divZero", "trap")
    return compared.withColumn(
        "verdict", F.when(~comparable, "inconclusive").when(agrees, "agree").otherwise("diverge")
    )


def _maybe(value: Column) -> Column:
    return F.struct(F.when(value.isNull(), "unmodelled").otherwise("ok").alias("outcome"), value.alias("value"))


def audit_summary(audited: DataFrame) -> DataFrame:
    return audited.groupBy("op", "config", "outcome", "verdict").agg(F.count("*").alias("n"))


def fits_obligations(obs: DataFrame, intermediates: dict[str, Column], is_signed: bool, bits: int) -> DataFrame:
    """Per row the intermediates of a recorded expression that leave their width, and whether none does."""
    machine = numeric.Machine.fixed(is_signed, bits)
    outside = [F.when(~machine.in_range(expr.cast(numeric.INT)), F.lit(name)) for name, expr in intermediates.items()]
    return obs.withColumn("overflowing", F.array_compact(F.array(*outside))).withColumn(
        "fits", F.size("overflowing") == 0
    )


def fits_all(flagged: DataFrame, by: list[str]) -> DataFrame:
    return flagged.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(~F.col("fits")).alias("leaving"), F.bool_and("fits").alias("holds")
    )
