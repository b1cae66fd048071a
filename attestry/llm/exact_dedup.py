"""Exact dedup by deterministic block naming: equal identity if and only if equal bytes, whatever a hash does.

A text is cut into blocks of fixed size. All distinct blocks of the corpus are sorted and get integer names; then adjacent
names are paired and the distinct pairs named in the same way, round after round, until one name is left for each document.
Names of one round are distinct for distinct blocks or pairs, so (round, name) identifies a text without collision.

The blocks themselves are shuffled once, combined before the shuffle: for each 64-bit hash the least and the greatest block.
Where both are equal, the hash stands for one block and its number in sorted order is the block's name; where they differ, the
hashes have collided, and those blocks are sorted and joined by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import let, prepare, texts, written

BLOCK_BYTES = 4096
BUCKET_BITS = 16
RANK_BITS = 40
NO_ID = -(2**63)


def _named(distinct: DataFrame, hashed: Column, order: list[str]) -> DataFrame:
    """Adds `name`: the number within a bucket of hashes, in sorted order, under the bucket's own number. At least 1."""
    bucket = F.shiftrightunsigned(hashed, 64 - BUCKET_BITS)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return distinct.withColumn("bucket", bucket).withColumn("name", F.shiftleft("bucket", RANK_BITS) + rank.cast("long")).drop("bucket")


def _blocks(keyed: DataFrame, block_bytes: int, block_hash: Callable[[Column], Column]) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("int")
    each = lambda data: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))
    pieces = let(F.col("text").cast("binary"), each)
    cut = keyed.select("key", "text_hash", n.alias("n"), F.posexplode(pieces).alias("pos", "block"))
    return cut.withColumn("h", block_hash(F.col("block")))


def identities(keyed: DataFrame, block_bytes: int = BLOCK_BYTES, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(key, text_hash, round, name) for each distinct (key, text_hash) of `keyed` (key, text_hash, text)."""
    blocks = _blocks(keyed, block_bytes, block_hash)
    hashes = written(
        blocks.groupBy("h").agg(F.min("block").alias("least"), F.max("block").alias("most")).select("h", (F.col("least") != F.col("most")).alias("collided"))
    )
    collided = hashes.filter("collided").select("h")
    distinct = hashes.filter("NOT collided").select("h", F.lit(None).cast("binary").alias("block"))
    some = not collided.isEmpty()
    if some:
        distinct = distinct.unionByName(blocks.join(collided, "h", "left_semi").select("h", "block").distinct())
    names = _named(distinct, F.col("h"), ["h", "block"])
    names = written(names) if some else names
    place = ["key", "text_hash", "n", "pos"]
    current = blocks.select(*place, "h").join(names.filter("block IS NULL").select("h", "name"), "h").select(*place, "name")
    if some:
        current = current.unionByName(blocks.join(names.filter("block IS NOT NULL"), ["h", "block"]).select(*place, "name"))
    done, turn = [], 0
    while True:
        current = written(current.distinct() if turn == 0 else current)
        done.append(current.filter("n = 1").select("key", "text_hash", F.lit(turn).alias("round"), "name"))
        rest = current.filter("n > 1")
        if rest.isEmpty():
            break
        side = lambda k: F.coalesce(F.max(F.when(F.col("pos") % 2 == k, F.col("name"))), F.lit(0))
        pairs = rest.groupBy("key", "text_hash", ((F.col("n") + 1) / 2).cast("int").alias("n"), (F.col("pos") / 2).cast("int").alias("pos"))
        pairs = pairs.agg(side(0).alias("left"), side(1).alias("right"))
        names = _named(pairs.select("left", "right").distinct(), F.xxhash64("left", "right"), ["left", "right"])
        current = pairs.join(names, ["left", "right"]).select(*place, "name")
        turn += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256); of equal texts the row with the largest id stays.

    Null text counts as empty. Rows that repeat id and text are one row of the result, each counted in group_size. One id with
    several texts gives one row a text. A null id is never preferred: keep_id is null only if all ids of a text are null, and
    then those rows, having repeated one another, are one row and kept. An empty table gives an empty result; of extra columns none is read.
    """
    prepare(docs.sparkSession)
    keyed = texts(docs, id_col, text_col).select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("text_hash"))
    found = written(identities(keyed, block_bytes, block_hash))
    rows = keyed.groupBy("key", "text_hash").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("m"), F.max(F.sha2("text", 256)).alias("text_sha256"))
    rows = written(rows.join(found, ["key", "text_hash"]))
    groups = written(rows.groupBy("round", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("m").alias("group_size")))
    out = rows.join(groups, ["round", "name"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
