"""Character n-grams of whole texts in numpy, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from attestry.llm.common import worker_cache

SLICE = 1 << 20
SPACE = 32


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    cache = worker_cache("letters")
    if "table" not in cache:
        cache["table"] = np.array([chr(i).isalpha() for i in range(0x110000)])
    return cache["table"]


def words_of(text: str) -> np.ndarray:
    """Lower-cased code points, each run of other signs than letters as one space, a space at both ends. Empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points[~letter] = SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = points[keep]
    ends = [] if points[-1] == SPACE else [SPACE]
    return np.concatenate([[SPACE], points, ends]).astype(np.int64)


def slices(points: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Slices that overlap so that each n-gram up to `longest` begins in exactly one of them, at an offset below SLICE."""
    for at in range(0, len(points), SLICE):
        yield points[at : at + SLICE + longest - 1]


def windows(points: np.ndarray, n: int) -> np.ndarray:
    """Begins of the n-grams of a slice that lie in one word, its two boundary spaces included, and hold a letter."""
    count = min(len(points) - n + 1, SLICE)
    if count <= 0:
        return np.zeros(0, np.int64)
    space = points == SPACE
    good = ~space[:count] if n == 1 else np.ones(count, bool)
    for k in range(1, n - 1):
        good &= ~space[k : k + count]
    return np.flatnonzero(good)


def coded(points: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of a slice, n up to 3, as integers of 21 bits a sign."""
    at = windows(points, n)
    code = points[at]
    for k in range(1, n):
        code = (code << 21) | points[at + k]
    return code


def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums the counts of equal keys over several (keys, counts)."""
    if len(parts) == 1:
        return parts[0]
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
