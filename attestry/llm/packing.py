"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Texts are tokenized where they lie, and only piece lengths move on. A document longer than a sequence is cut into whole
sequences and a rest. Pieces are dealt at random into groups of about GROUP_PIECES, and each group is packed by itself: longest
piece first, into the first bin that still has room, which the tree of maxima finds in logarithmic time.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import prepare, pylist_batches, texts, worker_cache, written

SEQUENCE = 4096
END_ID = 2
GROUP_PIECES = 8192
CACHED_WORDS = 400_000  # of a generation
SIGNS = ".,!?;:|%*#$()"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of a text as bytes (little-endian, 32 bits an id).

    This vocabulary drops white space and lower-cases, and takes runs of letters apart from runs of other signs. So the ids of a
    text are those of its parts between blanks and line ends, and those of a word with signs behind it are the word's and the
    signs'. Ids of parts seen before are kept, in two generations of bounded size. Latin-1 texts, which the normalisation leaves
    alone, are lower-cased first. A text in which a special token is spelled out, in whatever case, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, parts: set[str]) -> None:
        """Makes `young` hold all of `parts`."""
        young, old = self.young, self.old
        split = []
        missing = set()
        for p in parts:
            if p in old:
                young[p] = old[p]
                continue
            word = p.rstrip(SIGNS)
            if word != p and word.isalpha() and word.lower().isalpha():
                split.append((p, word, p[len(word) :]))
                missing.update(w for w in split[-1][1:] if w not in young)
            else:
                missing.add(p)
        again = [p for p in missing if p in old]
        young.update((p, old[p]) for p in again)
        fresh = list(missing.difference(again))
        for at in range(0, len(fresh), 10_000):
            some = fresh[at : at + 10_000]
            young.update(zip(some, self._encode(some)))
        young.update((p, young[w] + young[signs]) for p, w, signs in split)

    def __call__(self, text: str) -> bytes:
        folded = text.lower()
        if any(s in folded for s in self.special):
            return self._encode([text])[0]
        try:
            text.encode("latin-1")
            text = folded
        except UnicodeEncodeError:
            pass
        parts = text.replace("\n", " ").split(" ")
        self._learn({p for p in parts if p not in self.young})
        out = b"".join(map(self.young.__getitem__, parts))
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {"": b""}
        return out


def encoder(path: str) -> Encoder:
    cache = worker_cache("encoders")
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For lengths in falling order, each at most `capacity`: bin and offset. O(n log n)."""
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)  # of each inner node the greatest room below; bins that are not open yet have all
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, size in enumerate(lengths.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= size
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


def _cut(path: str, sequence: int, end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, salt = encoder(path), np.array([end_id], "<u4").tobytes(), 0
        for ids, bodies in pylist_batches(batches, "doc_id", "text"):
            out = []
            for doc_id, text in zip(ids, bodies):
                data = encode(text) + end
                n = len(data) // 4
                for start in range(0, n, sequence):
                    piece = data[4 * start : 4 * (start + sequence)]
                    salt += 1
                    out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, salt))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return rows


def _pack(sequence: int):
    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("salt", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), sequence)
        number = table["group"].to_numpy() << 32
        table = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return table.append_column("sequence_id", pa.array(number + bins)).append_column("offset", pa.array(offsets))

    return group


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece.

    Null text counts as empty and gives one piece, the end id. Repeated rows are packed each for itself, a null id is carried.
    The number of groups follows the number of pieces, and pieces of one id are dealt apart. Pieces of equal length are taken in
    the order of id and start. An empty table gives an empty result; of extra columns none is read.
    """
    prepare(docs.sparkSession)
    pieces = written(texts(docs, id_col, text_col).mapInArrow(_cut(tokenizer_path, sequence, end_id), PIECES))
    groups = max(1, round(pieces.count() / group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_pack(sequence), PACKED)
