"""Similarity join on 5-word shingles with token-combination prefixes.

Shingles have one order for the whole corpus: frequent ones last, the most frequent at the very end, all others by hash. Two sets
that reach the threshold share at least two of the first `n - ceil(0.8 n) + 2` shingles of each (the prefix extended for k = 2).
So they share a shingle there that is not common, or two common ones: a set is indexed under each shingle of its prefix that is
not common and under each pair of those that are. A long set has too many pairs; it is indexed under its common shingles one by
one, and sets whose partners may be long or short are indexed both ways.

Equal sets are one class. Candidates become components as `linking` says; verification compares whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import prepare, texts, whole_row, written
from attestry.llm.linking import SMALL_KEY, linked
from attestry.llm.shingles import BASE, WIDTH, digest, mixed, shingle_sets

PERCENT = 80
# The order knows the MAX_FREQUENT most frequent shingles; a shingle is common if it is one of them and in this share of the rows.
MAX_FREQUENT = 1 << 19
COMMON_SHARE = 1 / 512
# Shingles are counted over all rows, in stretches of so many shingles; of a stretch, those of one class only are not reported.
STRETCH = 4_000_000
PAIRED_SIZE = 300
ONE = np.uint64(1)
NO_ID = -(2**63)
# Up to so many ids are sent to every task instead of shuffling the texts.
SENT_IDS = 1_000_000


def _census(width: int):
    """(doc_id, text_hash, cls, n) of all texts, and (token, cnt) of the shingles that several classes of a stretch share."""
    names = ["doc_id", "text_hash", "cls", "n", "token", "cnt"]

    def batch_of(found: dict, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([found.get(c, pa.nulls(size, pa.int64())) for c in names], names=names)

    def shared(seen: dict) -> pa.RecordBatch:
        token, cnt = np.unique(np.concatenate([*seen.values(), np.zeros(0, np.int64)]), return_counts=True)
        keep = cnt > 1
        return batch_of({"token": pa.array(token[keep]), "cnt": pa.array(cnt[keep].astype(np.int64))}, int(keep.sum()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = {}, 0
        for batch in batches:
            classes, sizes = [], []
            for s in shingle_sets(batch.column(1), width) if batch.num_rows else ():
                classes.append(digest(s) if len(s) else None)
                sizes.append(len(s))
                if len(s) and classes[-1] not in seen:
                    seen[classes[-1]] = s
                    held += len(s)
            yield batch_of({"doc_id": batch.column(0), "text_hash": batch.column(2), "cls": pa.array(classes, pa.int64()), "n": pa.array(sizes, pa.int64())}, batch.num_rows)
            if held > STRETCH:
                yield shared(seen)
                seen, held = {}, 0
        yield shared(seen)

    return rows


def prefix_length(n: int, percent: int, k: int = 2) -> int:
    return min(n, n - -(-percent * n // 100) + k)


def entries(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray, n_common: int, percent: int, paired: int = PAIRED_SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set is indexed, odd for pairs, and the place of their first shingle in the order of the set.

    `frequent`: sorted; `rank`: place of each among them, 0 for the most frequent; the first `n_common` places are common.
    """
    n = len(shingles)
    place = np.full(n, len(frequent), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        place = np.where(frequent[at] == shingles, rank[at], len(frequent))
    prefix = np.argsort(-place, kind="stable")[: prefix_length(n, percent)]
    common = place[prefix] < n_common
    tokens = shingles[prefix].view(np.uint64)
    places = np.arange(len(prefix))
    hot, at = tokens[common], places[common]
    keys, first = [tokens[~common] & ~ONE], [places[~common]]
    if 100 * n >= percent * paired:
        keys.append(mixed(hot ^ np.uint64(BASE)) & ~ONE)
        first.append(at)
    if percent * n <= 100 * paired and len(hot) > 1:
        i, j = np.triu_indices(len(hot), 1)
        keys.append(mixed(np.minimum(hot[i], hot[j]) * np.uint64(BASE) + np.maximum(hot[i], hot[j])) | ONE)
        first.append(at[i])
    key, place = np.concatenate(keys), np.concatenate(first)
    by_place = np.argsort(place, kind="stable")
    key, where = np.unique(key[by_place], return_index=True)
    return key.view(np.int64), place[by_place][where]


def _index(shared, width: int, percent: int, paired: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank, n_common = shared.value
        seen: set[int] = set()  # of the task: a copy needs no second entry
        for batch in batches:
            keys, places, classes = [], [], []
            for s in shingle_sets(batch.column(1), width):
                if len(s) > 1 and (cls := digest(s)) not in seen:
                    seen.add(cls)
                    key, place = entries(s, frequent, rank, n_common, percent, paired)
                    keys.append(key)
                    places.append(place)
                    classes.append(np.full(len(keys[-1]), cls, np.int64))
            if keys:
                columns = [np.concatenate(keys), np.concatenate(classes), np.concatenate(places).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "cls", "place"])

    return rows


def _sets(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for s in shingle_sets(batch.column(1), width)]
            if found:
                values = pa.array(np.concatenate(found))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in found], pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["cls", "shingles"])

    return rows


class _Join:
    def __init__(self, rows: DataFrame, width: int, percent: int, common_share: float, paired: int):
        self.rows, self.width, self.percent, self.paired = rows, width, percent, paired
        census = written(rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_census(width), "doc_id long, text_hash long, cls long, n long, token long, cnt long"))
        self.docs = census.filter("token IS NULL").select("doc_id", "text_hash", "cls", "n")
        total = self.docs.count()
        counts = census.filter("token IS NOT NULL").groupBy("token").agg(F.sum("cnt").alias("cnt"))
        top = counts.orderBy(F.desc("cnt"), "token").limit(MAX_FREQUENT).toArrow()
        tokens, counted = top["token"].to_numpy(), top["cnt"].to_numpy()
        order = np.argsort(tokens)
        self.frequent = (tokens[order], order, int((counted >= common_share * total).sum()))
        self.classes = written(self.docs.filter("n > 1").groupBy("cls").agg(F.max(F.coalesce("doc_id", F.lit(NO_ID))).alias("doc_id"), F.min("n").alias("n")))

    def index(self) -> DataFrame:
        """(key, cls, least) of the keys under which several classes stand.

        The first shingle that a linked pair has in common is in both prefixes, so no class shares a shingle before the first
        place at which it meets another class: `lead` shingles of it are its own. Classes with too many of their own are left
        out, and the class with the fewest under a key is `least`, as near copies are most like the one that was changed least.
        """
        shared = self.rows.sparkSession.sparkContext.broadcast(self.frequent)
        raw = self.rows.mapInArrow(_index(shared, self.width, self.percent, self.paired), "key long, cls long, place int")
        of_key = Window.partitionBy("key")
        ends = raw.withColumn("low", F.min("cls").over(of_key)).withColumn("high", F.max("cls").over(of_key))
        met = written(ends.filter("low <> high").select("key", "cls", "place"))
        lead = met.groupBy("cls").agg(F.min("place").cast("long").alias("lead"))
        able = 100 * (F.col("n") - F.col("lead")) >= self.percent * F.col("n")
        self.classes = written(self.classes.join(lead, "cls").filter(able))
        led = met.select("key", "cls").join(self.classes.select("cls", "lead"), "cls")
        first = led.withColumn("first", F.min(F.struct("lead", "cls")).over(of_key)).withColumn("many", F.count("*").over(of_key))
        return written(first.filter("many > 1").select("key", "cls", F.col("first.cls").alias("least")))

    def sized(self, pairs: DataFrame) -> DataFrame:
        """Adds na and nb; keeps pairs that can reach the threshold by their sizes and by what is not their own."""
        side = lambda x: self.classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), (F.col("n") - F.col("lead")).alias(f"rest{x}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b")
        enough = (100 + self.percent) * F.least("resta", "restb") >= self.percent * (F.col("na") + F.col("nb"))
        return pairs.filter(enough & (100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(cls, shingles) of the classes `wanted` (cls), from one text each."""
        ids = _sent(written(wanted.join(self.classes, "cls").select("doc_id").distinct()))
        found = self.rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).join(ids, "doc_id", "left_semi").select("doc_id", "text")
        return written(found.mapInArrow(_sets(self.width), "cls long, shingles array<long>").dropDuplicates(["cls"]))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs that reach the threshold."""
        pairs = written(pairs.select("a", "b"))
        if pairs.isEmpty():
            return pairs
        sets = self.sets(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct())
        side = lambda x: sets.select(F.col("cls").alias(x), F.col("shingles").alias(f"s{x}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a")
        shared = F.size(F.array_intersect("sa", "sb"))
        alike = (100 + self.percent) * shared >= self.percent * (F.size("sa") + F.size("sb"))
        return written(both.filter(alike).select("a", "b"))


def _rooted(rows: DataFrame, width: int, percent: int, common_share: float, paired: int, small: int) -> DataFrame:
    """(doc_id, text_hash, n, root) of `rows` (doc_id, text); root is null without words, else one class of the component."""
    work = _Join(rows, width, percent, common_share, paired)
    index = work.index()
    # Shared prefix shingles of a pair: at least those it needs beyond the shingles outside the prefix. A shared pair of common
    # shingles may stand for any number of them, a single one for none.
    outside = lambda n: F.floor(F.col(n) * percent / 100) - 1
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent)) - F.greatest(outside("na"), outside("nb")) - 2
    roots = linked(
        index,
        lambda pairs: work.verified(work.sized(pairs)),
        lambda classes: work.sets(classes).withColumnRenamed("shingles", "items"),
        percent,
        lambda star: work.sized(star).filter("20 * shared >= least(na, nb)"),
        lambda pairs: work.sized(pairs).filter((F.col("odd") > 0) | (F.col("shared") >= need)),
        small,
    )
    found = work.docs.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    return written(found.select("doc_id", "text_hash", "n", F.coalesce("root", "cls").alias("root")))


def similarity_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    common_share: float = COMMON_SHARE,
    paired: int = PAIRED_SIZE,
    small: int = SMALL_KEY,
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each input row, repeated rows included.

    component_id is the smallest id reachable by links. Null text counts as empty; a row without words has 0 shingles and is alone.
    Null ids don't count for the smallest id; a component of null ids only has null. An empty table gives an empty result; of
    extra columns none is read. `common_share`, `paired` and `small` choose between ways of equal result.
    """
    prepare(docs.sparkSession)
    rooted = _rooted(texts(docs, id_col, text_col), width, percent, common_share, paired, small)
    least = written(rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")))
    out = rooted.filter("root IS NOT NULL").join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return out.unionByName(rooted.filter("root IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, all columns as they are, of which each component keeps one: that of the smallest id, null last.

    Of rows that repeat an id and a text one stays; of several texts of that id, the one with the smallest hash. Rows without
    words are all kept. An empty table gives an empty result; no other column than id and text is read.
    """
    prepare(docs.sparkSession)
    rooted = _rooted(texts(docs, id_col, text_col), width, percent, COMMON_SHARE, PAIRED_SIZE, SMALL_KEY).filter("root IS NOT NULL")
    rooted = rooted.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID)))
    order = F.struct((F.col("key") == NO_ID).alias("none"), "key", "text_hash")
    counted = written(rooted.groupBy("root", "key", "text_hash").agg(F.count("*").alias("m")))
    first = written(counted.groupBy("root").agg(F.min(order).alias("first"), F.sum("m").alias("all")).filter("all > 1").select("root", "first"))
    judged = written(counted.join(first, "root").select("key", "text_hash", (order == F.col("first")).alias("stays"), "m"))
    key, text_hash = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    rows = docs.select(whole_row(docs), key.alias("key"), text_hash.alias("text_hash"))
    gone = judged.filter("NOT stays OR m > 1").select("key", "text_hash")
    out = rows.join(_sent(gone), ["key", "text_hash"], "left_anti")
    again = judged.filter("stays AND m > 1").select("key", "text_hash")
    if not again.isEmpty():
        out = out.unionByName(rows.join(_sent(again), ["key", "text_hash"], "left_semi").dropDuplicates(["key", "text_hash"]).select("row", "key", "text_hash"))
    return out.select("row.*")


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids
