"""An FM-index over a sequence of small integers: suffix array, wavelet ranks, backward search, sampled locate."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of s by prefix doubling; s ends with a symbol that is smaller than all others."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[1:] = ordered[1:] != ordered[:-1]
        np.cumsum(fresh, out=fresh)
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletRanks:
    """Ranks of every symbol in a sequence, by one prefix count per bit of the alphabet."""

    def __init__(self, s: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.bits)):
            bit = (s >> level) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (c >> (self.bits - 1 - level)) & 1
            r = ones[i]
            i = np.where(bit == 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c occurs before place i."""
        return self._down(c, i) - self._down(c, np.zeros_like(i))


class FMIndex:
    """Index of s; symbols are 1 and up, 1 separates, 0 is the end mark that is added here."""

    STEP = 8

    def __init__(self, s: np.ndarray, alphabet: int):
        s = np.append(s, 0).astype(np.int64)
        order = suffix_array(s)
        self.last = s[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=alphabet))])
        self.ranks = WaveletRanks(self.last, alphabet)
        kept = order % self.STEP == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each pattern (rows, padded at the left), by backward search."""
        n = len(self.last)
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), n, np.int64)
        width = patterns.shape[1]
        for k in range(1, width + 1):
            live = np.flatnonzero((lengths >= k) & (lo < hi))
            if len(live):
                c = patterns[live, width - k]
                lo[live] = self.below[c] + self.ranks.rank(c, lo[live])
                hi[live] = self.below[c] + self.ranks.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to the next sampled one."""
        rows = rows.copy()
        found = np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        steps = 0
        while len(live):
            at = rows[live]
            hit = self.kept[at + 1] > self.kept[at]
            found[live[hit]] = self.places[self.kept[at[hit]]] + steps
            live, at = live[~hit], at[~hit]
            c = self.last[at]
            rows[live] = self.below[c] + self.ranks.rank(c, at)
            steps += 1
        return found
