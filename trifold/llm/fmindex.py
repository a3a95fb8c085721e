"""A compressed FM-index over integer symbols, in numpy.

The suffixes are sorted by their first ``depth`` symbols, which is all that
patterns of up to ``depth`` symbols need.  Ranks in the Burrows-Wheeler
transform come from a wavelet matrix of packed bits with block counts.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = (now >> level) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))[:-1]]).astype(np.int64))
            self.zeros.append(int(len(now) - bits.sum()))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        self.begin = np.zeros(n_symbols, np.int64)
        self.begin = self._map(np.arange(n_symbols), self.begin)

    def _map(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block = i >> 6
            mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][block] + np.bitwise_count(self.words[k][block] & mask)
            i = np.where((c >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c occurs before position i."""
        return self._map(c, i) - self.begin[c]


def _pairs(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of (a[i], b[i + shift]); beyond the end counts as lowest."""
    late = np.zeros(len(a), np.int64)
    late[: len(a) - shift] = b[shift:] + 1
    return np.unique(a * (int(b.max()) + 2) + late, return_inverse=True)[1]


class FMIndex:
    """Of ``symbols`` (0 parts the texts), for patterns of up to ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, depth: int):
        n = len(symbols)
        rank, known = symbols.astype(np.int64), 1
        while known * 2 <= depth:
            rank = _pairs(rank, rank, min(known, n))
            known *= 2
        if known < depth:  # two overlapping ranks reach the full depth
            rank = _pairs(rank, rank, min(depth - known, n))
        self.depth = depth
        self.suffixes = np.argsort(rank, kind="stable")
        wrapped = np.concatenate([symbols[-1:], symbols[:-1]])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        self.wavelet = WaveletMatrix(wrapped[self.suffixes], n_symbols)
        padded = np.concatenate([symbols, np.full(depth, -1)])
        common, same = np.zeros(n, np.int64), np.ones(n - 1, bool)
        for j in range(depth):
            x = padded[self.suffixes + j]
            same &= (x[1:] == x[:-1]) & (x[1:] >= 0)
            common[1:] += same
        common[:1] = -1
        self.common = common
        place = np.arange(n, dtype=np.int32)
        self.low, self.high = np.empty((2, depth + 1, n), np.int32)  # the range of suffixes that share d symbols with each
        for d in range(depth + 1):
            self.low[d] = np.maximum.accumulate(np.where(common < d, place, 0))
            after = np.append(common[1:] < d, True)
            self.high[d] = np.minimum.accumulate(np.where(after, place + 1, n)[::-1])[::-1]
        self.n = n

    def step(self, c, low, high):
        """Backward search: the suffixes that begin with c and go on with those of low to high."""
        return self.before[c] + self.wavelet.rank(c, low), self.before[c] + self.wavelet.rank(c, high)

    def matching_statistics(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the query texts (``first``: where each begins, one more for the end), the length of
        the longest match from there on, up to ``depth``, and one suffix that has it.

        All texts go from right to left together.  A match that has full length, or can't be extended, is
        shortened at its right end first, by the suffixes' common beginnings."""
        length, where = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        end, size = first[1:][order], size[order]
        low, high, d = np.zeros(len(size), np.int64), np.full(len(size), self.n), np.zeros(len(size), np.int64)
        lows, highs = self.low, self.high
        for t in range(1, int(size[0]) + 1 if len(size) else 0):
            k = int(np.searchsorted(-size, -t, side="right"))
            at = end[:k] - t
            c = symbols[at]
            low, high, d = low[:k], high[:k], d[:k]
            full = np.flatnonzero(d == self.depth)
            d[full] -= 1
            low[full], high[full] = lows[d[full], low[full]], highs[d[full], low[full]]
            known = c >= 0
            new_low, new_high = self.step(np.where(known, c, 0), low, high)
            miss = np.flatnonzero((new_low >= new_high) & (d > 0) & known)
            while len(miss):
                d[miss] -= 1
                a = low[miss]
                low[miss], high[miss] = np.where(d[miss] > 0, lows[d[miss], a], 0), np.where(d[miss] > 0, highs[d[miss], a], self.n)
                new_low[miss], new_high[miss] = self.step(c[miss], low[miss], high[miss])
                miss = miss[(new_low[miss] >= new_high[miss]) & (d[miss] > 0)]
            found = known & (new_low < new_high)
            low, high, d = np.where(found, new_low, 0), np.where(found, new_high, self.n), np.where(found, d + 1, 0)
            length[at], where[at] = d, low
        return length, where
