"""Language-model scores by stupid backoff, n-gram counts joined back to the texts that ask for them.

Counts cover all words of all documents. A word is known by a 64-bit hash of its text, an n-gram by a 64-bit hash of its words.
Documents are dealt into chunks of about CHUNK_BYTES, one row each. A chunk asks once for each n-gram it holds, whatever the number
of its occurrences: a row for each part of the range of hashes, with the n-grams of the chunk in it and their counts there. Rows of
one part meet in one task, which adds up and answers each row with the counts of the whole corpus, in the order of the question; a
chunk and its answers meet again and all its documents are scored there. So each n-gram of a chunk is shuffled once, as the gap to
the one before it (about 6 bytes), and its answer as a count. Parts are as many as the words of the corpus ask for, so none grows
with the corpus.

S(w | context) is count(context w) / count(context) if the n-gram occurs at least MIN_COUNT times, else BACKOFF times the score
with the context shortened by its first word; a single word scores its share of all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import prepare, texts, written
from attestry.llm.shingles import BASE, mixed, text_bytes, words

ORDER = 3
MIN_SHARE = 0.0  # words of a smaller share of all words become one unknown word; 0: none does
MIN_COUNT = 2
BACKOFF = 0.4
CHUNK_BYTES = 6 << 20  # of text, about a million words; a longer document is a chunk of its own
LEVEL = 6  # of zstd, for the texts of a chunk
PART_GRAMS = 2_000_000  # n-grams with their repetitions that a part of the range of hashes stands for
TASK_PARTS = 16  # parts that one task may add up after another before there are more tasks
CHUNKS = "chunk long, n_words long, ids array<long>, sizes array<long>, texts binary"
ASKED = "part long, chunk long, n long, grams binary, counts binary"


def word_hashes(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of each word's text; 0 for words that are not `known`, if only some are."""
    hashes, text = words(data, offsets)
    if known is not None:
        hashes[~np.isin(hashes, known)] = 0
    return hashes, text


def n_words(data: np.ndarray, offsets: np.ndarray) -> int:
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    return int(np.count_nonzero(~blank & (first[:-1] | np.concatenate([[True], blank[:-1]])[: len(blank)])))


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers compressed, the first bytes of all, then the second bytes and so on: of small numbers most are zero."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpacked(data, n: int, kind) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def grams_of(hashes: np.ndarray, text: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order up to `order`, the hashes of the n-grams and the number of the last word of each. None spans two texts."""
    single = mixed(hashes + np.uint64(BASE))
    ends, keys = np.arange(len(single)), single
    yield keys, ends
    for n in range(2, order + 1):
        longer = ends[1:][(np.diff(ends) == 1) & (text[ends[1:]] == text[ends[1:] - n + 1])] if len(ends) else ends
        before = keys[np.searchsorted(ends, longer - 1)]
        keys, ends = mixed(before * np.uint64(0xD6E8FEB86659FD93) + single[longer] + np.uint64(n)), longer
        yield keys, ends


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the range of hashes, in rising order for rising keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, count, number = [], 0, 0, TaskContext.get().partitionId() << 32

    def row() -> pa.RecordBatch:
        data = np.concatenate([d for _, d, _ in held])
        sizes = np.concatenate([np.diff(o) for _, _, o in held])
        ids = pa.concat_arrays([i for i, _, _ in held])
        of_all = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        body = pa.Codec("zstd", compression_level=LEVEL).compress(data.data, asbytes=True)
        columns = [pa.array([number]), pa.array([count]), of_all(ids), of_all(pa.array(sizes)), pa.array([body], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "n_words", "ids", "sizes", "texts"])

    for batch in batches:
        if batch.num_rows:
            data, offsets = text_bytes(batch.column(1))
            held.append((batch.column(0), data.copy(), offsets))
            size, count = size + len(data), count + n_words(data, offsets)
        if size >= CHUNK_BYTES:
            yield row()
            held, size, count, number = [], 0, 0, number + 1
    if held:
        yield row()


def _opened(row: dict, known) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array(row["sizes"], np.int64)
    data = np.frombuffer(pa.decompress(row["texts"], int(sizes.sum()), codec="zstd", asbytes=True), np.uint8)
    return word_hashes(data, np.concatenate([[0], np.cumsum(sizes)]), known and known.value)


def _asked(known, order: int, parts: int):
    """(part, chunk, n, grams, counts): the distinct n-grams of a chunk by part, sorted, each as the gap to the one before it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                each = [np.unique(keys, return_counts=True) for keys, _ in grams_of(*_opened(row, known), order)]
                keys, counts = (np.concatenate([e[i] for e in each]) for i in range(2))
                by_key = np.argsort(keys, kind="stable")
                keys, counts = keys[by_key], counts[by_key].astype(np.int64)
                cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(cuts))
                if not len(full):
                    continue
                at = list(zip(cuts[full].tolist(), cuts[full + 1].tolist()))
                cells = [[packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in at], [packed(counts[a:b]) for a, b in at]]
                columns = [pa.array(full), pa.array(np.full(len(full), row["chunk"], np.int64)), pa.array([b - a for a, b in at]), *(pa.array(c, pa.binary()) for c in cells)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "n", "grams", "counts"])

    return rows


def _added(table: pa.Table) -> pa.Table:
    """(chunk, part, n, totals): for each row of a part the counts of its n-grams in all rows."""
    size = table["n"].to_pylist()
    read = lambda name, kind: [unpacked(cell.as_buffer(), n, kind) for cell, n in zip(table[name], size)]
    keys, at = np.unique(np.concatenate([np.cumsum(gaps, dtype=np.uint64) for gaps in read("grams", np.uint64)]), return_inverse=True)
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, at, np.concatenate(read("counts", np.int64)))
    answers, end = [], 0
    for n in size:
        answers.append(packed(totals[at[end : end + n]]))
        end += n
    return pa.table([table["chunk"], table["part"], table["n"], pa.array(answers, pa.binary())], names=["chunk", "part", "n", "totals"])


def _scored(known, order: int, total: int, min_count: int, backoff: float):
    def group(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunks.to_pylist()[0]
        hashes, text = _opened(row, known)
        answers = answers.sort_by("part")
        totals = [unpacked(cell.as_buffer(), n, np.int64) for cell, n in zip(answers["totals"], answers["n"].to_pylist())]
        totals = np.concatenate([*totals, np.zeros(0, np.int64)])
        found = [(ends, *np.unique(keys, return_inverse=True)) for keys, ends in grams_of(hashes, text, order)]
        in_turn = np.empty(len(totals), np.int64)
        in_turn[np.argsort(np.concatenate([keys for _, keys, _ in found]), kind="stable")] = totals
        score, context, before = np.zeros(0), None, 0
        for n, (ends, keys, at) in enumerate(found, 1):
            count = in_turn[before : before + len(keys)][at]
            before += len(keys)
            if n == 1:
                score = count / total if total else np.zeros(0)
            else:
                score[ends] = np.where(count >= min_count, count / context[ends - 1], backoff * score[ends])
            context = np.zeros(len(hashes), np.int64)
            context[ends] = count
        size = np.bincount(text, minlength=len(row["ids"]))
        logs = np.bincount(text, np.log(score), minlength=len(row["ids"]))
        mean = pa.array(logs / np.maximum(size, 1), mask=size == 0)
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(size.astype(np.int64)), mean], names=["doc_id", "n_words", "mean_log"])

    return group


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    min_share: float = MIN_SHARE,
    min_count: int = MIN_COUNT,
    backoff: float = BACKOFF,
) -> DataFrame:
    """(doc_id, n_words, mean_log), one row for each input row: number of words and the mean of the logarithms of their scores.

    Words are lower-cased. A null or empty text has 0 words and a null mean. Rows that repeat an id and a text each get the same
    result and each count in the corpus; null ids are carried. An empty table gives an empty result; of extra columns none is read.
    With a `min_share` above 0, all words of a smaller share of all words are one unknown word. A task holds a chunk, or a part.
    """
    spark = prepare(docs.sparkSession)
    rows = texts(docs, id_col, text_col).select("doc_id", F.lower("text").alias("text"))
    known = None
    if min_share > 0:
        split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
        counted = written(rows.select(F.explode(split).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
        total = counted.agg(F.sum("n")).first()[0] or 0
        often = [r.word for r in counted.filter(F.col("n") >= min_share * total).select("word").collect()]  # at most 1 / min_share words
        data = np.frombuffer(" ".join(often).encode(), np.uint8)
        known = spark.sparkContext.broadcast(words(data, np.array([0, len(data)]))[0])
    chunks = written(rows.mapInArrow(_chunks, CHUNKS))
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(partitions, -(-total * order // PART_GRAMS))
    asked = chunks.mapInArrow(_asked(known, order, parts), ASKED)
    if parts > TASK_PARTS * partitions:
        asked = asked.repartition(parts // TASK_PARTS, "part")
    answers = written(asked.groupBy("part").applyInArrow(_added, "chunk long, part long, n long, totals binary"))  # frees the questions
    both = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInArrow(_scored(known, order, total, min_count, backoff), "doc_id long, n_words long, mean_log double")
