"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Items are partitioned by the size of their shingle set (powers of two). In each partition an item is indexed under the smallest
hashes of its shingles; how many follows from the partition's largest size u: floor((1 - t) u) + 1. A document that contains at
least a share t of an item lacks at most floor((1 - t) q) of its q shingles, so it holds one of these hashes at least, and at
least `least_hits` of them in all: the search is exact for any length of document, as the documents' own size plays no part.
Documents that hold enough hashes of an item are verified by their shingles as text.

Texts don't move: their shingle hashes meet the item index, which is broadcast up to SENT_ROWS rows and joined by shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import prepare, texts, whole_row, written

WIDTH = 5
PERCENT = 80
SENT_ROWS = 1_000_000
NO_ID = -(2**63)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _windows(width: int) -> Column:
    """First places of the shingles of `ws`; one for the whole sequence of fewer words, none without words."""
    n = F.size("ws")
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), n - (width - 1)))).otherwise(F.array().cast("array<int>"))


def shingles(width: int) -> Column:
    return F.transform(_windows(width), lambda i: F.array_join(F.slice("ws", i, width), " "))


def shingle_hashes(width: int) -> Column:
    """Hashes of the words of each shingle. Words beyond the end are null, which the hash skips."""
    return F.transform(_windows(width), lambda i: F.xxhash64(*[F.try_element_at("ws", i + k) for k in range(width)]))


def sketches(items: DataFrame, width: int, percent: int) -> DataFrame:
    """(item_id, n, h, least_hits) of items (item_id, ws): the smallest hashes of each, as many as its partition asks for."""
    hashed = items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(width))).alias("hs")).filter(F.size("hs") > 0)
    n = F.size("hs")
    largest = (F.pow(F.lit(2), F.length(F.bin(n))) - 1).cast("int")
    may_lack = lambda k: F.floor(k * (100 - percent) / 100).cast("int")
    taken = F.least(n, may_lack(largest) + 1)
    return hashed.select("item_id", n.alias("n"), (taken - may_lack(n)).alias("least_hits"), F.explode(F.slice("hs", 1, taken)).alias("h"))


def _sent(table: DataFrame) -> DataFrame:
    """A written table, marked to be broadcast if it has at most SENT_ROWS rows."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, text_hash, item_id, n_item, n_shared): each document and item of which it holds at least `percent` of the shingles.

    Words are lower-cased; an item with fewer words than `width` is one shingle and is only found in a text that equals it. Null
    and empty texts hold nothing and are held by nothing. Rows that repeat an id and a text are one document, text_hash tells
    several texts of one id apart; items that repeat an id count each for itself if their texts differ. Null ids are carried. Empty
    tables give an empty result; of extra columns none is read.
    """
    prepare(docs.sparkSession)
    rows = texts(docs, id_col, text_col).select("text", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("text_hash"))
    number = F.struct(items[item_col].cast("long").alias("id"), F.xxhash64(F.coalesce(items[text_col].cast("string"), F.lit(""))).alias("text_hash"))
    wordy = items.select(number.alias("item_id"), words(items[text_col].cast("string")).alias("ws")).filter(F.size("ws") > 0)
    wordy = written(wordy.dropDuplicates(["item_id"]))
    sketch = written(sketches(wordy, width, percent))
    split = rows.select("key", "text_hash", words(F.col("text")).alias("ws"))
    hits = split.select("key", "text_hash", F.explode(shingle_hashes(width)).alias("h")).join(_sent(sketch), "h")
    found = hits.groupBy("key", "text_hash", "item_id", "n", "least_hits").agg(F.count_distinct("h").alias("hits")).filter("hits >= least_hits")
    found = written(found.select("key", "text_hash", "item_id"))
    of_item = written(wordy.join(found.select("item_id").distinct(), "item_id").select("item_id", F.array_distinct(shingles(width)).alias("s")))
    of_item = written(of_item.select("item_id", F.size("s").alias("n_item"), F.explode("s").alias("s")))
    held = split.join(_sent(written(found.select("key", "text_hash").distinct())), ["key", "text_hash"], "left_semi")
    held = held.select("key", "text_hash", F.explode(F.array_distinct(shingles(width))).alias("s"))
    # One row a document and shingle, also where the document's row is repeated; an item's row is counted once for each.
    shared = held.join(_sent(of_item), "s").groupBy("key", "text_hash", "item_id", "n_item").agg(F.count_distinct("s").alias("n_shared"))
    held = shared.join(found, ["key", "text_hash", "item_id"], "left_semi").filter(100 * F.col("n_shared") >= percent * F.col("n_item"))
    doc_id = F.when(F.col("key") != NO_ID, F.col("key"))
    return held.select(doc_id.alias("doc_id"), "text_hash", F.col("item_id.id").alias("item_id"), F.col("n_item").cast("long").alias("n_item"), "n_shared")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text holds no item. See `contaminated` for the cases."""
    bad = contaminated(docs, items, id_col, text_col, **options).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text_hash")
    bad = _sent(written(bad.distinct()))
    key = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("key")
    text = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("text_hash")
    return docs.select(whole_row(docs), key, text).join(bad, ["key", "text_hash"], "left_anti").select("row.*")
