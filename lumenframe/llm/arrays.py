"""Texts of Arrow batches as flat numpy arrays: lower-cased bytes, hashes of words and of parts of words, hash tables.

Everything works on the concatenated bytes of many texts at once, so the cost is a few array operations per byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lumenframe.llm.common import mix64

#: Symbols beside the 256 bytes: the end of a text, and what stands before its start.
END, START = 256, 257
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(258, bool)
_SPACE[[9, 10, 11, 12, 13, 32, END, START]] = True
#: ASCII letters and all bytes of other characters.
_LETTER = np.zeros(258, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_RANDOM = mix64(np.arange(1, 259, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: An odd base and its inverse modulo 2^64.
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string or binary array, and the places where texts begin and the last one ends. Null: empty."""
    a = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary())
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64 if pa.types.is_large_binary(a.type) else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def symbols(column: pa.Array, starts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of symbols: each is `starts` times START, its bytes with A-Z lower-cased, then END.

    The second array has the place of each text's first START, and the length of all.
    """
    data, offsets = raw_bytes(column)
    n = len(offsets) - 1
    out = np.full(len(data) + n * (starts + 1), START, np.uint16)
    at = offsets + np.arange(n + 1) * (starts + 1)
    place = np.ones(len(out), bool)
    place[at[1:] - 1] = False
    for i in range(starts):
        place[at[:-1] + i] = False
    out[place] = _LOWER[data]
    out[at[1:] - 1] = END
    return out, at


def fold_accents(s: np.ndarray) -> np.ndarray:
    """Also lower-case the letters of Latin-1 that UTF-8 writes as two bytes (C3 80-9E)."""
    after = np.append(False, s[:-1] == 0xC3)
    return np.where(after & (s >= 0x80) & (s <= 0x9E) & (s != 0x97), s + 0x20, s).astype(s.dtype)


class Spans:
    """Runs of symbols of one kind, and hashes of any part of them from prefix sums modulo 2^64."""

    def __init__(self, s: np.ndarray, kind: np.ndarray):
        inside = kind[s]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(s) and inside[0]:
            edge = np.append(0, edge)
        if len(s) and inside[-1]:
            edge = np.append(edge, len(s))
        self.start, self.end = edge[::2], edge[1::2]
        up, self._down = _powers(len(s) + 1)
        self._sums = np.append(np.uint64(0), np.cumsum(_RANDOM[s] * up[: len(s)]))

    def hash(self, start: np.ndarray | None = None, end: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
        """64-bit hashes of the parts from start to end; of whole runs by default."""
        a, b = self.start if start is None else start, self.end if end is None else end
        return mix64((self._sums[b] - self._sums[a]) * self._down[a] + np.uint64(salt))

    def per_text(self, at: np.ndarray) -> np.ndarray:
        """Number of the first run of each text, and of all runs."""
        return np.searchsorted(self.start, at)


def words(s: np.ndarray) -> Spans:
    """Words: runs of anything but ASCII white space."""
    return Spans(s, ~_SPACE)


def letter_runs(s: np.ndarray) -> Spans:
    """Runs of letters (bytes beyond ASCII count as letters)."""
    return Spans(s, _LETTER)


#: The hash of a text's end as a token of its own.
END_TOKEN = int(mix64(np.array([END], np.uint64))[0])


def counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their numbers or sums of weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    n = np.diff(np.append(first, len(keys))) if weights is None else np.add.reduceat(weights, first)
    return keys[first], n


class Table:
    """A hash table of distinct 64-bit keys: find() gives their places in the arrays that it was made of, or -1."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.value[slot] < 0
            self.value[slot[free]] = left[free]  # of several the last one stays
            self.keys[slot] = np.where(self.value[slot] == left, keys[left], self.keys[slot])
            lost = self.value[slot] != left
            left, slot = left[lost], (slot[lost] + np.uint64(1)) & self.mask
        self.keys[self.value >= 0] = keys[self.value[self.value >= 0]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        slot = self._slot(keys)
        found = self.value[slot]
        left = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        slot = slot[left]
        while len(left):
            slot = (slot + np.uint64(1)) & self.mask
            found[left] = self.value[slot]
            more = (found[left] >= 0) & (self.keys[slot] != keys[left])
            left, slot = left[more], slot[more]
        return found
