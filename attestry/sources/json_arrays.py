"""Records of large JSON arrays, each file read by many tasks.

Spark's text reader cuts a file into splits and, with a brace as the line separator, a split into fragments that end in a brace.
Whether a fragment starts inside a string, and how deep, follows from all before it: quotes change the one, brackets outside
strings the other. So fragments are summed up within their split for both cases, the sums of splits are scanned along the file
(a few numbers for each split), and each fragment gets its state from that of its split. A record ends with the brace that
brings the depth back to that of the array; its index is the number of records that end before it, counted the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.session import stored

#: Characters shown of what is left behind the last whole record of a broken file.
SHOWN = 1000
SPLIT = ["source_path", "split"]


def fragments(spark: SparkSession, glob: str) -> DataFrame:
    """(source_path, split, seq, text), in the order of split and seq; the brace behind each is left out."""
    raw = spark.read.option("lineSep", "}").text(glob)
    return raw.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"))


def _depth(text: Column) -> Column:
    """Opening less closing brackets."""
    without = lambda chars: F.length(F.translate(text, chars, ""))
    return without("}]") - without("{[")


def _measured(pieces: DataFrame) -> DataFrame:
    """With `turns` (1 if the fragment goes into or out of a string on the whole), and the depth it adds if it starts outside or inside."""
    plain = F.regexp_replace("text", r"(?s)\\.", "")
    parts = F.split(plain, '"', -1)
    side = lambda odd: F.array_join(F.filter("parts", lambda _, i: i % 2 == odd), "")
    cut = pieces.withColumn("parts", parts)
    return cut.select(*SPLIT, "seq", "text", ((F.size("parts") - 1) % 2).alias("turns"), _depth(side(0)).alias("outside"), _depth(side(1)).alias("inside"))


def _before(column: str, *by: str) -> Column:
    """Sum of `column` over all rows before, in the order of the last of `by` within the others."""
    window = Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _placed(pieces: DataFrame) -> DataFrame:
    """(source_path, split, seq, text, closes, depth, last): whether the brace behind is one, and the depth after it."""
    measured = stored(_measured(pieces).withColumn("flips", _before("turns", *SPLIT, "seq") % 2))
    # Added depth, the brace behind included, for both states of the split's start.
    starts = lambda state: (F.col("flips") + state) % 2
    ends = lambda state: (F.col("flips") + F.col("turns") + state) % 2
    adds = lambda state: F.when(starts(state) == 0, F.col("outside")).otherwise(F.col("inside")) - F.when(ends(state) == 0, 1).otherwise(0)
    sums = measured.groupBy(*SPLIT).agg(F.sum("turns").alias("turns"), F.sum(adds(0)).alias("from_outside"), F.sum(adds(1)).alias("from_inside"), F.max("seq").alias("last_seq"))
    states = sums.withColumn("state", _before("turns", *SPLIT) % 2)
    states = states.withColumn("added", F.when(F.col("state") == 0, F.col("from_outside")).otherwise(F.col("from_inside")))
    last = F.col("split") == F.max("split").over(Window.partitionBy("source_path"))
    states = states.select(*SPLIT, "state", _before("added", *SPLIT).alias("base"), F.when(last, F.col("last_seq")).alias("last_seq"))
    joined = measured.join(states, SPLIT)
    final = F.coalesce(F.col("seq") == F.col("last_seq"), F.lit(False))
    joined = joined.select(*SPLIT, "seq", "text", "base", (~final & (ends(F.col("state")) == 0)).alias("closes"), adds(F.col("state")).alias("adds"), final.alias("last"))
    running = Window.partitionBy(*SPLIT).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn("depth", F.col("base") + F.sum("adds").over(running)).drop("base", "adds")


def heads(spark: SparkSession, glob: str) -> DataFrame:
    """(source_path, is_array) of each file that is not empty."""
    first = fragments(spark, glob).groupBy("source_path").agg(F.min_by("text", F.struct("split", "seq")).alias("text"))
    return first.select("source_path", F.col("text").rlike(r"^\uFEFF?\s*\[").alias("is_array"))


def records(spark: SparkSession, glob: str) -> DataFrame:
    """(source_path, pos, record, whole): the records of the arrays of a glob as text, by their index in the array.

    If more than the array's end stands behind the last whole record, its first fragment is a row that is not `whole`, cut to
    `SHOWN` characters. A file that is no array has no whole record at depth 1 and shows up in the same way.
    """
    placed = stored(_placed(fragments(spark, glob)).withColumn("ends", (F.col("closes") & (F.col("depth") == 1)).cast("long")))
    counts = placed.groupBy(*SPLIT).agg(F.sum("ends").alias("n"))
    total = F.sum("n").over(Window.partitionBy("source_path"))
    counts = counts.select(*SPLIT, _before("n", *SPLIT).alias("records_before"), total.alias("total"))
    numbered = placed.join(counts, SPLIT).withColumn("pos", F.col("records_before") + _before("ends", *SPLIT, "seq"))
    place = F.struct("split", "seq")
    inner = numbered.filter("pos < total").groupBy("source_path", "pos").agg(F.sort_array(F.collect_list(F.struct("split", "seq", "text"))).alias("parts"))
    joined = F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), "}"), F.lit("}"))
    whole = inner.select("source_path", "pos", _headless(joined).alias("record"), F.lit(True).alias("whole"))
    behind = numbered.filter("pos = total").groupBy("source_path", "pos").agg(F.min_by("text", place).alias("text"), F.count("*").alias("n"))
    behind = behind.select("source_path", "pos", F.substring(_headless(F.col("text")), 1, SHOWN).alias("record"), F.lit(False).alias("whole"), "n")
    return whole.unionByName(behind.filter(~((F.col("n") == 1) & F.col("record").rlike(r"^\]\s*$"))).drop("n"))


def _headless(record: Column) -> Column:
    """Without the array's start, or the comma, before a record."""
    return F.regexp_replace(record, r"^\uFEFF?\s*[\[,]?\s*", "")
