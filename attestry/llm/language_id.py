"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams in order. A document's own list is compared with each
profile: an n-gram adds the difference of its two places, or the length of the list if the profile lacks it; the language with
the smallest sum wins. Profiles are counted over the whole text of every row with a label, in Spark; only the profiles, at most
`profile_size` n-grams for each language, come to the driver and go out with the tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import prepare, pylist_batches, remainder
from attestry.llm.grams import coded, counted, slices, words_of

ORDERS = (1, 2, 3)
PROFILE_SIZE = 400
UNKNOWN = "und"
MIN_SCORE = 0.25


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    points = words_of(text) if text else np.zeros(0, np.int64)
    parts = [np.unique(np.concatenate([coded(s, n) for n in ORDERS]), return_counts=True) for s in slices(points, max(ORDERS))]
    return counted(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for langs, bodies in pylist_batches(batches, "lang", "text"):
        parts = defaultdict(list)
        for lang, text in zip(langs, bodies):
            parts[lang].append(gram_counts(text))
        for lang, some in parts.items():
            grams, counts = counted(some)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


@dataclass
class Profiles:
    """langs in order of their names; grams sorted; rank[i, j]: place of gram j in the profile of language i, or size."""

    langs: list[str]
    grams: np.ndarray
    rank: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and 1 - distance / greatest distance. Equal distances: the first language by name."""
        grams, counts = gram_counts(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        top = grams[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        rank = np.where(self.grams[at] == top, self.rank[:, at], self.size)
        far = np.where(rank == self.size, self.size, np.abs(rank - np.arange(len(top)))).sum(axis=1)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.size * len(top)))


def train(labelled: DataFrame, profile_size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from all rows of `labelled` (text, lang); null labels or texts count for nothing."""
    rows = labelled.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = counts.withColumn("place", place).filter(F.col("place") <= profile_size).select("lang", "gram", "place").collect()
    langs = sorted({r.lang for r in found})
    grams = np.unique(np.array([r.gram for r in found], np.int64))
    rank = np.full((len(langs), len(grams)), profile_size, np.int64)
    number = {lang: i for i, lang in enumerate(langs)}
    for r in found:
        rank[number[r.lang], np.searchsorted(grams, r.gram)] = r.place - 1
    return Profiles(langs, grams, rank, profile_size)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of `docs` (doc_id, text, held_out), without a shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held, bodies in pylist_batches(batches, "doc_id", "held_out", "text"):
            found = [profiles.predict(t) for t in bodies]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each input row, repeated rows included.

    Learns from rows whose crc32(doc_id) modulo 4 is not 2 and whose label is not null. A row without id is not learnt from and
    not held out. A null text or one without letters is `und` with score 0, as is every row if nothing could be learnt. An empty
    table gives an empty result; of extra columns none is read.
    """
    prepare(docs.sparkSession)
    mod = remainder(docs[id_col].cast("long"), 4)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), mod.alias("mod"))
    profiles = train(rows.filter("mod <> 2").select("text", "lang"))
    return predict(rows.select("doc_id", "text", F.coalesce(F.col("mod") == 2, F.lit(False)).alias("held_out")), profiles)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text has a language: not `und`, and a score of at least `min_score`.

    A language without a profile shares next to no n-gram with those that have one and scores close to 0; texts of a known language,
    one word long or full of noise, stay well above. Learns as `identify` does; if nothing could be learnt, no row is kept.
    """
    prepare(docs.sparkSession)
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), remainder(docs[id_col].cast("long"), 4).alias("mod"))
    profiles = train(rows.filter("mod <> 2").select("text", "lang"))
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
