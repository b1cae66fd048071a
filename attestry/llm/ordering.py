"""Places of rows in a total order of a whole table, found by all tasks together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import written

ROW_BITS = 33  # Spark's increasing ids hold the partition above these bits and the row in it below


def in_order(df: DataFrame, by: list, deal_by: list | None = None) -> DataFrame:
    """`df` range-partitioned and sorted by `by`; `deal_by`, if given, are coarser keys in the same order to draw the ranges from."""
    return df.repartitionByRange(*(deal_by or by)).sortWithinPartitions(*by)


def ranked(df: DataFrame, by: list, deal_by: list | None = None) -> DataFrame:
    """`df` with `rank`, counted from 0 without gaps in the order of `by`, which should be total; written.

    One range partitioning; the offsets of partitions are one row for each partition, so they may be broadcast.
    """
    placed = written(in_order(df, by, deal_by).withColumn("rank", F.monotonically_increasing_id()))
    part = F.shiftright("rank", ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("rank").bitwiseAND((1 << ROW_BITS) - 1)
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn("rank", rank).drop("_part", "_before")
