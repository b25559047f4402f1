"""A compressed FM-index over word symbols: wavelet matrix of the BWT, backward search."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Wavelet matrix: one packed bit vector with 64-bit blocks a level."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n, self.levels = len(values), max(1, int(max(sigma - 1, 1)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        v = values.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = ((v >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(ones)]))
            self.zeros.append(self.n - int(ones.sum()))
            v = np.concatenate([v[~bit], v[bit]])

    def ends(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` lands in the last level if it follows ``symbol``'s bits."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            block = i >> 6
            low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][block] + np.bitwise_count(self.words[k][block] & low)
            i = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, i - ones)
        return i


class FmIndex:
    """FM-index of a symbol text (0 separates passages) for patterns of up to 16 symbols.

    Suffixes are ordered by their first 16 symbols, by prefix doubling: rows of a
    pattern that short are one interval, and backward search steps from the
    interval of P to that of cP by C[c] + rank_c.  What stays is the wavelet matrix of
    the BWT (log2 sigma bits a symbol and its rank directory), C, and for every row the
    owner of its suffix (``owner`` gives that of every text position) in 32 bits; the
    suffix array itself is dropped.
    """

    DEPTH = 16

    def __init__(self, text: np.ndarray, sigma: int, owner: np.ndarray):
        n = len(text)
        rank = text.astype(np.int64)
        sa = np.argsort(rank, kind="stable")
        h = 1
        while h < self.DEPTH and n > 1:
            key = rank * (int(rank.max()) + 2)
            key[: n - h] += rank[h:] + 1
            sa = np.argsort(key, kind="stable")
            new = np.ones(n, bool)
            new[1:] = key[sa][1:] != key[sa][:-1]
            rank = np.empty(n, np.int64)
            rank[sa] = np.cumsum(new) - 1
            h *= 2
        self.n = n
        self.owner = owner.astype(np.int32)[sa]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = Wavelet(text[sa - 1], sigma)
        every = np.arange(sigma)
        self.origin = self.bwt.ends(every, np.zeros(sigma, np.int64))

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Intervals of cP from those of P."""
        base = self.first[symbol] - self.origin[symbol]
        return base + self.bwt.ends(symbol, lo), base + self.bwt.ends(symbol, hi)

    def matching(self, text: np.ndarray, ends: np.ndarray, limit: int, least: int = 2):
        """Matching statistics at the positions ``ends`` (exclusive) of a streamed ``text``: the
        length of the longest ``text[e - length : e]``, ``limit`` at most, that occurs ``least``
        times in the index, and its interval [lo, hi).  A symbol the index lacks is -1."""
        size = np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        live, a, b = np.arange(len(ends)), lo, hi
        for k in range(1, limit + 1):
            symbol = text[ends[live] - k]
            known = symbol >= 0
            live, a, b, symbol = live[known], a[known], b[known], symbol[known]
            a, b = self.step(symbol, a, b) if k > 1 else (self.first[symbol], self.first[symbol + 1])
            more = b - a >= least
            live, a, b = live[more], a[more], b[more]
            size[live], lo[live], hi[live] = k, a, b
            if not len(live):
                break
        return size, lo, hi

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least owner in each of the non-empty intervals (sorted, disjoint or equal)."""
        u, back = np.unique(lo, return_inverse=True)
        top = np.zeros(len(u), np.int64)
        top[back] = hi
        rows = np.append(self.owner, np.iinfo(np.int32).max)
        return np.minimum.reduceat(rows, np.stack([u, top], 1).ravel())[::2][back]
