"""Word shingles of whole Arrow batches in numpy: 64-bit hashes of words, combined over windows of words.

Words are runs of other bytes than blank and tab to carriage return; A-Z count as a-z. Two different words or shingles share a
hash with a chance of about 2**-64, which the operators that use them accept as equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from attestry.llm.common import worker_cache

WIDTH = 5
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C17
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    cache = worker_cache("powers")
    if len(cache.get(base, ())) < n:
        powers = np.full(max(n, CHUNK), base, np.uint64)
        powers[0] = 1
        cache[base] = np.multiply.accumulate(powers)
    return cache[base][:n]


def _letters() -> np.ndarray:
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    values[65:91] = values[97:123]
    return values


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts that lie one after another in `data`, and the number of each word's text."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    inside = ~blank
    begin = np.flatnonzero(inside & (first[:-1] | np.concatenate([[True], blank[:-1]])))
    finish = np.flatnonzero(inside & (first[1:] | np.concatenate([blank[1:], [True]]))) + 1
    hashes = np.empty(len(begin), np.uint64)
    values, at = _letters(), 0
    while at < len(begin):
        low = begin[at]
        to = max(at + 1, int(np.searchsorted(finish, low + CHUNK, "right")))
        part = data[low : finish[to - 1]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[part] * _powers(BASE, len(part)))])
        b, f = begin[at:to] - low, finish[at:to] - low
        hashes[at:to] = mixed((sums[f] - sums[b]) * _powers(INVERSE, len(part))[b] + (f - b).astype(np.uint64))
        at = to
    return hashes, np.searchsorted(offsets, begin, "right") - 1


def combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of `width` words."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(BASE) + hashes[k : k + n])
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text its sorted set of shingles as int64; the whole sequence of a text with fewer words; empty without words."""
    data, offsets = text_bytes(column)
    hashes, text = words(data, offsets)
    cuts = np.searchsorted(text, np.arange(len(column) + 1))
    every = combined(hashes, width).view(np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= width:
            yield np.unique(every[a : b - width + 1])
        else:
            yield combined(hashes[a:b], b - a).view(np.int64) if b > a else every[:0]


def digest(shingles: np.ndarray) -> int:
    """One 64-bit number for a set."""
    h = mixed(shingles.view(np.uint64) * np.uint64(BASE)).sum(dtype=np.uint64)
    return int(mixed(np.array([h + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])
