"""Places of rows within groups when one group may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import stored

ROW_BITS = 33  # Spark's increasing ids hold the partition above these bits and the row in it below


def rank_in_group(df: DataFrame, key: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """`df` with the place of each row in its group, from 0, in the order of `order`, which should be total within a group.

    Rows are range-partitioned by key and order, so that a large group is sorted by many tasks. Each task has a run of the group;
    the runs are counted, the counts of the runs before are added up (a row for each run), and a row's place is that of its run
    and its own in the run. Null keys are a group.
    """
    placed = stored(df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS)
    runs = placed.groupBy(*key, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.struct(*key).alias("_of"), F.col("_part"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = placed.join(runs, (part == F.col("_part")) & F.struct(*[placed[k] for k in key]).eqNullSafe(F.col("_of")))
    return joined.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_of", "_part", "_shift")
