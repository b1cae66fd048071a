"""Bodies of an Arrow batch opened together: brackets, strings and keys are found for all of them by array operations.

Only bodies in plain shape are read here; `Opened.odd` numbers the others (an escape in a string, a key or value of a kind the
arrays don't tell, brackets or quotes that don't pair), which the caller opens one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

QUOTE, ESCAPE, COLON, OPEN, CLOSE, BLANK = (ord(c) for c in '"\\:{} ')
_PADDING = 20


def _words(starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second eight bytes of each string, zero beyond its end."""
    view = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    mask = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
    return view[starts] & mask[np.clip(lengths, 0, 8)], view[starts + 8] & mask[np.clip(lengths - 8, 0, 8)]


def _code(word: str) -> tuple[int, int]:
    raw = word.encode().ljust(16, b"\0")
    return int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")


class Opened:
    """Objects in the order of their opening brackets, which is the preorder of the walk.

    `doc`, `depth` (1 for a root) and `kind` (as `values` gives it) for each object; `first` is the number of a body's root. `odd` grows with
    every `odd_where`. Keys written twice are told only where they are asked for.
    """

    def __init__(self, bodies: pa.Array):
        bodies = bodies.cast(pa.string())
        offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
        raw = np.frombuffer(bodies.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.edges = offsets - offsets[0]
        self.data = np.concatenate([raw, np.zeros(_PADDING, np.uint8)])
        self.odd = np.zeros(len(bodies), bool)
        while (odd := self._read()).any():  # so that quotes and brackets of different bodies never pair
            self.odd |= odd
            for i in np.flatnonzero(odd):
                self.data[self.edges[i] : self.edges[i + 1]] = BLANK
        self.kind = self.values("k")
        self.odd_where(self.kind[3])

    def _read(self) -> np.ndarray:
        """Strings and brackets; tells bodies whose signs don't pair or that hold escapes, or blanks between a string and the next sign."""
        data, edges = self.data, self.edges
        of = lambda places: np.searchsorted(edges, places, "right") - 1
        quotes = np.flatnonzero(data == QUOTE)
        odd = np.diff(np.searchsorted(quotes, edges)) % 2 > 0
        if (escapes := data == ESCAPE).any():
            odd[of(np.flatnonzero(escapes))] = True
        if odd.any():
            return odd
        self.starts, self.stops = quotes[0::2], quotes[1::2]
        after = data[self.stops + 1]
        odd[of(self.stops[after <= BLANK])] = True
        braces = np.flatnonzero((data == OPEN) | (data == CLOSE))
        braces = braces[np.searchsorted(quotes, braces) % 2 == 0]
        opening = data[braces] == OPEN
        level = np.cumsum(np.where(opening, 1, -1))
        borders, blank = np.searchsorted(braces, edges), np.concatenate([[0], level])
        roots = np.bincount(of(braces[opening & (level == 1)]), minlength=len(odd))
        odd |= (np.diff(blank[borders]) != 0) | ((roots != 1) & ~self.odd)
        odd[of(braces[level < 0])] = True
        self.braces, self.opening, self.level = braces, opening, level
        self.opens, self.depth = braces[opening], level[opening]
        self.doc = of(self.opens)
        self.first = np.searchsorted(self.doc, np.arange(len(odd)))
        self._keys = np.flatnonzero(after == COLON)
        self._short = self._keys[self.stops[self._keys] - self.starts[self._keys] == 2]
        return odd & ~self.odd

    def odd_where(self, objects: np.ndarray) -> None:
        self.odd[self.doc[objects]] = True

    def _owner(self, places: np.ndarray) -> np.ndarray:
        """The object that holds each key: mostly its bracket is the last before; else the last one opened at the key's level."""
        last = np.searchsorted(self.braces, places) - 1
        found = np.cumsum(self.opening)[last] - 1
        far = ~self.opening[last]
        if far.any():
            size = len(self.data)
            order = np.argsort(self.depth, kind="stable")
            placed = self.depth[order] * size + self.opens[order]
            found[far] = order[np.searchsorted(placed, self.level[last[far]] * size + places[far]) - 1]
        return found

    def values(self, key: str, numbers: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each object: has it text under the key, the text's place and length, and is the value another (or written twice).

        Text is a string and, with `numbers`, a whole number as `str` would write it.
        """
        if len(key) == 1:
            keys = self._short[self.data[self.starts[self._short] + 1] == ord(key)]
        else:
            lengths = self.stops[self._keys] - self.starts[self._keys] - 1
            (a, b), (x, y) = _words(self.starts[self._keys] + 1, lengths, self.data), _code(key)
            keys = self._keys[(lengths == len(key)) & (a == x) & (b == y)]
        n = len(self.opens)
        has, start, length, other = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        owner, value = self._owner(self.starts[keys]), self.stops[keys] + 2
        value += self.data[value] == BLANK
        other[np.bincount(owner, minlength=n) > 1] = True
        text = self.data[value] == QUOTE
        o, following = owner[text], keys[text] + 1
        has[o], start[o], length[o] = True, value[text] + 1, self.stops[following] - value[text] - 1
        o, value = owner[~text], value[~text]
        if numbers and len(o):
            signs = np.flatnonzero((self.data - np.uint8(48)) > 9)
            lengths = signs[np.searchsorted(signs, value)] - value
            plain = (lengths > 0) & ((self.data[value] != 48) | (lengths == 1)) & np.isin(self.data[value + lengths], [ord(c) for c in ",]} \n"])
            has[o[plain]], start[o[plain]], length[o[plain]] = True, value[plain], lengths[plain]
            o = o[~plain]
        other[o] = True
        return has, start, length, other

    def holds_object(self, key: str) -> np.ndarray:
        """Objects whose only value under a key of one sign is an object."""
        keys = self._short[self.data[self.starts[self._short] + 1] == ord(key)]
        owner, value = self._owner(self.starts[keys]), self.stops[keys] + 2
        value += self.data[value] == BLANK
        found = np.zeros(len(self.opens), bool)
        found[owner[self.data[value] == OPEN]] = True
        return found & (np.bincount(owner, minlength=len(found)) == 1)

    def is_kind(self, *kinds: str) -> np.ndarray:
        has, start, length, _ = self.kind
        if not hasattr(self, "_codes"):
            self._codes = _words(start, length, self.data)
        (a, b), found = self._codes, np.zeros(len(has), bool)
        for k in kinds:
            x, y = _code(k)
            found |= (a == x) & (b == y) & (length == len(k))
        return found & has

    def below(self, *kinds: str) -> np.ndarray:
        """Objects strictly inside one of the kinds."""
        tops = self.is_kind(*kinds)
        if not tops.any():
            return np.zeros(len(self.opens), bool)
        at = np.flatnonzero(self.opening)[tops]
        both = np.argsort((self.level + ~self.opening).astype(np.int16) if self.level.max() < 32_000 else self.level + ~self.opening, kind="stable")
        close = np.zeros(len(self.braces), np.int64)
        close[both[0::2]] = both[1::2]
        step = np.zeros(len(self.braces) + 1, np.int64)
        step[at + 1] += 1
        step[close[at]] -= 1
        return np.cumsum(step)[:-1][self.opening] > 0

    def texts(self, has: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
        """Arrow strings of spans; null where there is none."""
        length = np.where(has, length, 0)
        ends = np.cumsum(length)
        data = self.data[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        valid = pa.py_buffer(np.packbits(has, bitorder="little"))
        return pa.StringArray.from_buffers(len(has), pa.py_buffer(offsets), pa.py_buffer(data), valid)
