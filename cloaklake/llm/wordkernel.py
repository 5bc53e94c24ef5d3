"""Words and shingles of Arrow text columns as NumPy arrays, without an object for each word.

All functions work on UTF-8 bytes: the word classes used here are ASCII sets and their complements, for which bytes and
characters give the same words. Hashes have 64 bits; n different words or shingles collide with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE, _STEP, _LEN = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(kind: str) -> np.ndarray:
    """Which bytes are in words. space: all but blank and 09-0D; plain: digits, letters and all beyond ASCII."""
    t = np.ones(256, dtype=bool)
    if kind == "space":
        t[[0x20, *range(0x09, 0x0E)]] = False
    elif kind == "plain":
        for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
            t[lo : hi + 1] = False
        t[0x41:0x5B] = True  # lower-cased before the class applies
    else:
        raise ValueError(kind)
    return t


CLASSES = {k: byte_class(k) for k in ("space", "plain")}


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all 64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_powers = np.ones(1, dtype=U64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 4096), _BASE, dtype=U64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=U64)
    return _powers


def step_powers(k: int) -> np.ndarray:
    p = np.full(k, _STEP, dtype=U64)
    p[0] = 1
    return np.cumprod(p, dtype=U64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes each (one row at least), so that work arrays stay small."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of rows i..j: start and end (in `low`, the lower-cased bytes), hash, and for each row its first word."""

    __slots__ = ("low", "start", "end", "hash", "first")

    def __init__(self, data: np.ndarray, off: np.ndarray, i: int, j: int, kind: str):
        o = off[i : j + 1] - off[i]
        d = data[off[i] : off[j]]
        w = CLASSES[kind][d]
        self.low = LOWER[d]
        edge = o[1:-1][(o[1:-1] > 0) & (o[1:-1] < len(d))]
        s, e = w.copy(), w.copy()
        if len(d):
            s[1:] &= ~w[:-1]
            s[edge] = w[edge]
            e[:-1] &= ~w[1:]
            e[edge - 1] = w[edge - 1]
        self.start = np.flatnonzero(s)
        self.end = np.flatnonzero(e) + 1
        self.first = np.searchsorted(self.start, o)
        if len(self.start):
            span = np.diff(self.start, append=len(d))
            length = self.end - self.start
            place = np.arange(self.start[0], len(d)) - np.repeat(self.start, span)
            value = (self.low[self.start[0] :].astype(np.uint16) + 1) * w[self.start[0] :]
            h = np.add.reduceat(value.astype(U64) * powers(int(span.max()))[place], self.start - self.start[0])
            self.hash = mixed(h + length.astype(U64) * _LEN)
        else:
            self.hash = np.zeros(0, U64)

    def of_row(self, r: int) -> slice:
        return slice(int(self.first[r]), int(self.first[r + 1]))

    def bytes_of(self, k: int) -> bytes:
        return self.low[self.start[k] : self.end[k]].tobytes()

    def strings(self, which: np.ndarray) -> pa.Array:
        """The words at `which` as a binary Arrow array."""
        s, e = self.start[which], self.end[which]
        n = e - s
        off = np.zeros(len(which) + 1, np.int64)
        np.cumsum(n, out=off[1:])
        at = np.arange(off[-1]) - np.repeat(off[:-1] - s, n)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(off), pa.py_buffer(self.low[at])])


def hash_of(word: str) -> int:
    """The hash that Words gives to this word."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(Words(raw, np.array([0, len(raw)]), 0, 1, "space").hash[0])


def shingles(words: Words, row: int, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the row's k-word shingles; of the whole row if it has fewer words; none without words."""
    h = words.hash[words.of_row(row)]
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    step = step_powers(k)
    out = h[:n].copy()
    for j in range(1, min(k, len(h))):
        out += h[j : j + n] * step[j]
    if len(h) < k:
        out += np.full(1, len(h), U64) * _LEN
    return np.unique(mixed(out))


class CodeTable:
    """Codes of 64-bit keys: open addressing over arrays, looked up and filled many keys at a time."""

    def __init__(self, bits: int = 16):
        self.keys, self.codes, self.used = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key, -1 where it has none."""
        keys = np.maximum(keys, U64(1))
        mask = U64(len(self.keys) - 1)
        slot = (keys & mask).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == keys, self.codes[slot], -1).astype(np.int64)
        left = np.flatnonzero((got != keys) & (got != 0))
        while len(left):
            at = (slot[left] + 1) & int(mask)
            slot[left] = at
            got = self.keys[at]
            hit = got == keys[left]
            out[left[hit]] = self.codes[at[hit]]
            left = left[~hit & (got != 0)]
        return out

    def add(self, keys: np.ndarray, codes: np.ndarray) -> None:
        """Distinct keys that have no code yet."""
        keys = np.maximum(keys, U64(1))
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys != 0
            k, c = self.keys[old], self.codes[old]
            self.__init__(int(2 * (self.used + len(keys))).bit_length())
            self._put(k, c)
        self._put(keys, codes)

    def _put(self, keys: np.ndarray, codes: np.ndarray) -> None:
        self.used += len(keys)
        mask = len(self.keys) - 1
        slot = (keys & U64(mask)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            own = self.keys[slot] == keys
            self.codes[slot[own]] = codes[own]
            keys, codes, slot = keys[~own], codes[~own], (slot[~own] + 1) & mask
