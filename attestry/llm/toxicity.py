"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Every word is a bag of character n-grams with its boundaries; each n-gram has a vector (hashed into a fixed number of rows), a
document is the mean of its vectors, and a linear softmax over two classes reads the mean. Vectors and softmax are trained
jointly in numpy, so a misspelling that was never seen still shares most of its n-grams with the word. The model is fitted on a
bounded sample of labelled rows (MAX_PER_CLASS of each class, the smallest hashes of their ids); every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import prepare, pylist_batches, remainder
from attestry.llm.grams import slices, windows, words_of

ORDERS = (3, 4, 5)
ROWS = 1 << 17
DIM = 8
MAX_PER_CLASS = 2000
EPOCHS = 8
BATCH = 64
RATE = 0.05
MIX = 0x9E3779B97F4A7C15


def subwords(text: str | None) -> Iterator[np.ndarray]:
    """Vector rows of all n-grams of the text, a bounded slice at a time."""
    for points in slices(words_of(text or ""), max(ORDERS)):
        points = points.astype(np.uint64)
        for n in ORDERS:
            at = windows(points, n)
            code = np.full(len(at), n, np.uint64)
            for k in range(n):
                code = (code ^ points[at + k]) * np.uint64(MIX)
                code ^= code >> np.uint64(29)
            yield (code & np.uint64(ROWS - 1)).astype(np.int64)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their shares in the document's mean."""
    total = np.zeros(0, np.int64)
    for rows in subwords(text):
        counts = np.bincount(rows, minlength=ROWS)
        total = counts if not len(total) else total + counts
    rows = np.flatnonzero(total)
    return rows.astype(np.int32), (total[rows] / max(1, total.sum())).astype(np.float32)


@dataclass
class Model:
    """logit: for each row, its vector times the difference of the two softmax columns; a document's score is linear in its mean."""

    logit: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total = n = 0
        for rows in subwords(text):
            total += float(self.logit[rows].sum(dtype=np.float64))
            n += len(rows)
        return float(1 / (1 + np.exp(-np.clip(total / max(1, n) + self.bias, -50, 50))))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Model:
    """Adam on vectors and softmax together. The gradient of all vectors is an outer product of one row-sum with the softmax."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    slots = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, soft, bias)]
    scale = np.float32(100.0)  # a mean over many n-grams is small; steps of one rate fit vectors and softmax alike
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            sizes = np.array([len(bags[i][0]) for i in some])
            rows = np.concatenate([bags[i][0] for i in some])
            share = np.concatenate([bags[i][1] for i in some]) * scale
            doc = np.repeat(np.arange(len(some)), sizes)
            diff = soft[:, 1] - soft[:, 0]
            value = np.bincount(doc, (vectors @ diff)[rows] * share, minlength=len(some)) + bias[1] - bias[0]
            p = 1 / (1 + np.exp(-np.clip(value, -50, 50)))
            g = ((p - labels[some]) * weights[some] / len(some)).astype(np.float32)
            by_row = np.bincount(rows, g[doc] * share, minlength=ROWS).astype(np.float32)
            towards = by_row @ vectors
            grads = (by_row[:, None] * diff[None, :], np.stack([-towards, towards], 1), np.array([-g.sum(), g.sum()], np.float32))
            step += 1
            for p_, (m, v), grad in zip((vectors, soft, bias), slots, grads):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p_ -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(((vectors @ (soft[:, 1] - soft[:, 0])) * scale).astype(np.float32), float(bias[1] - bias[0]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for labels, bodies in pylist_batches(batches, "toxic", "text"):
        found = [bag(t) for t in bodies]
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], names=["toxic", "rows", "share"])


def train(rows: DataFrame, marks: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    """Model from the texts of `rows` (doc_id, text) and `marks` (doc_id, toxic), one row an id.

    At most `max_per_class` ids of each class are drawn, by the hash of the id; classes weigh as they do in all labels. Of several
    texts of an id the greatest is read.
    """
    ids = marks.join(rows.select("doc_id"), "doc_id", "left_semi")
    share = {r.toxic: r.n for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return Model(np.zeros(ROWS, np.float32), 50.0 if share.get(1) else -50.0)
    drawn = [ids.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for k in (0, 1)]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * max_per_class rows
    texts = rows.join(drawn, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    found = texts.orderBy("doc_id").select("toxic", "text").mapInArrow(_bags, "toxic int, rows binary, share binary").collect()
    labels = np.array([r.toxic for r in found])
    drawn_share = np.array([share[k] / max(1, (labels == k).sum()) for k in (0, 1)])
    weights = drawn_share[labels] * len(labels) / sum(share.values())
    return fit([(np.frombuffer(r.rows, np.int32), np.frombuffer(r.share, np.float32)) for r in found], labels, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of `docs` (doc_id, text, held_out), without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.logit, model.bias))  # ROWS floats; plain values, as code travels with the task

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held, bodies in pylist_batches(batches, "doc_id", "held_out", "text"):
            fitted = Model(*shared.value)
            found = [fitted.score(t) for t in bodies]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each input row, repeated rows included.

    Learns from labels (doc_id, toxic 0 or 1) of ids whose crc32 modulo 5 is not 0; several labels of one id count as the greatest,
    null or other labels as none. A row without id is not learnt from and not held out. Null text counts as empty and, like any
    text without letters, has the score of the bias. With labels of one class only, or none, every score is that class (none: 0).
    An empty table gives an empty result; of extra columns none is read.
    """
    prepare(docs.sparkSession)
    doc_id = docs[id_col].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), docs[text_col].cast("string").alias("text"), F.coalesce(remainder(doc_id, 5) == 0, F.lit(False)).alias("held_out"))
    marks = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic")).filter(remainder("doc_id", 5) != 0)
    marks = marks.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return score(rows, train(rows.select("doc_id", "text"), marks))
