"""Words of whole texts as numpy arrays over UTF-8 bytes.

A word is a maximal run of bytes that are a digit, a letter a-z after lower-casing A-Z, or part of a
non-ASCII character: the same words as the pattern [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ takes. A null text has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_LOWER = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _LOWER[_b] = _b
for _b in range(0x41, 0x5B):
    _LOWER[_b] = _b + 32

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 20)
        grow = np.full(size, _BASE, U64)
        grow[0] = 1
        back = np.full(size, _INVERSE, U64)
        back[0] = 1
        _powers, _inverses = np.multiply.accumulate(grow), np.multiply.accumulate(back)
    return _powers[:n], _inverses[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


class Words:
    """Words of some rows: byte places (start, end), 64-bit hashes, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _LOWER[data]
        inside = low != 0
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[offsets] = False
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[offsets] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        power, self._inverse = powers(len(data) + 1)
        self._total = np.zeros(len(data) + 1, U64)
        np.cumsum(low * power[:-1], out=self._total[1:])
        self.hash = self._between(self.end)

    def _between(self, end: np.ndarray) -> np.ndarray:
        length = (end - self.start).astype(U64)
        return mix((self._total[end] - self._total[self.start]) * self._inverse[self.start] + length * U64(0xD6E8FEB86659FD93))

    def prefix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(which words are at least size bytes long, hashes of their first size bytes)."""
        long = np.flatnonzero(self.end - self.start >= size)
        start = self.start[long]
        return long, mix((self._total[start + size] - self._total[start]) * self._inverse[start] + U64(size * 0xC2B2AE3D27D4EB4F % 2**64))

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(texts: list[str | None]) -> Words:
    return Words(*utf8(pa.array(texts, pa.string())))
