"""FM-index of a shard: suffix order, wavelet matrix over the Burrows-Wheeler transform, matching statistics by backward search.

Symbols are non-negative integers; 0 parts the texts. Searches are those of many texts at a time: each step prepends one symbol to the
current match of every text, so one step is a few array operations whatever the number of texts.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence, from one packed bit vector per bit of the alphabet."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for shift in range(bits - 1, -1, -1):
            bit = (values >> shift) & 1
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            zeros = int(len(bit) - bit.sum())
            self.levels.append((packed, before, zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        packed, before, _ = level
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before ``lo`` and before ``hi``."""
        start = np.zeros_like(lo)
        for k, level in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b, s = (self._ones(level, x) for x in (lo, hi, start))
            lo, hi, start = (np.where(one, level[2] + ones, at - ones) for at, ones in ((lo, a), (hi, b), (start, s)))
        return lo - start, hi - start


class FmIndex:
    """Suffixes of ``symbols`` (0 between texts) ordered by their first 32 symbols; answers searches of up to ``width`` <= 24 symbols."""

    def __init__(self, symbols: np.ndarray, width: int):
        n = len(symbols)
        rank = {1: np.append(symbols.astype(np.int64), 0)}
        size = 1
        while size < 32:
            r = rank[size]
            second = np.zeros(n + 1, np.int64)
            second[: n + 1 - size] = r[size:] + 1
            key = r * (int(r.max()) + 3) + second
            rank[size * 2] = np.unique(key, return_inverse=True)[1].astype(np.int64)
            size *= 2
        self.width, self.order = width, np.argsort(rank[32], kind="stable")
        before = np.append(symbols, 0)[self.order - 1]
        self.first = np.searchsorted(np.sort(np.append(symbols, 0)), np.arange(int(symbols.max(initial=0)) + 2))
        self.bwt = WaveletMatrix(before.astype(np.int64), max(1, int(symbols.max(initial=1)).bit_length()))
        self.group = self._groups(rank, width)
        starts = self._groups(rank, width - 1)
        self.short_start = starts
        self.short_end = np.append(np.flatnonzero(np.diff(starts)) + 1, n + 1)[np.cumsum(np.append(0, np.diff(starts) > 0))]

    def _groups(self, rank: dict, width: int) -> np.ndarray:
        """For each place in the suffix order, the first place with the same ``width`` symbols."""
        fresh = np.zeros(len(self.order), bool)
        fresh[0] = True
        at, left = self.order, width
        for size in (16, 8, 4, 2, 1):
            if left >= size:
                r = rank[size][np.minimum(at, len(self.order) - 1)]
                fresh[1:] |= r[1:] != r[:-1]
                at, left = at + size, left - size
        return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))

    def least(self, keys: np.ndarray) -> np.ndarray:
        """For each place of a group of equal ``width`` symbols, at the group's first place: the least key of its suffixes."""
        heads = np.flatnonzero(np.append(True, np.diff(self.group) > 0))
        out = np.full(len(self.order), np.iinfo(np.int64).max)
        out[heads] = np.minimum.reduceat(np.append(keys, np.iinfo(np.int64).max)[self.order], heads)
        return out

    def matches(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Matching statistics cut at ``width``: for each symbol of the streamed texts ``symbols[begin:end]``, the first place in the
        suffix order of the ``width`` symbols from there on, or -1 where the index has no such match."""
        found = np.full(len(symbols), -1, np.int64)
        at, stop = end.copy(), begin
        length = np.zeros(len(at), np.int64)
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        live = np.flatnonzero(at > stop)
        while len(live):
            c = symbols[at[live] - 1]
            full = length[live] == self.width
            lo_, hi_ = lo[live], hi[live]
            hi_ = np.where(full, self.short_end[np.minimum(lo_, len(self.order) - 1)], hi_)
            lo_ = np.where(full, self.short_start[np.minimum(lo_, len(self.order) - 1)], lo_)
            size = np.where(full, self.width - 1, length[live])
            known = c < len(self.first) - 1
            c_ = np.where(known, c, 0)
            a, b = self.bwt.rank(c_, lo_, hi_)
            a, b = self.first[c_] + a, self.first[c_] + b
            hit = known & (b > a)
            at[live] -= 1
            lo[live], hi[live] = np.where(hit, a, 0), np.where(hit, b, len(self.order))
            length[live] = np.where(hit, size + 1, 0)
            # no match of symbol + match: go on with texts that end one symbol earlier
            at[live] += np.where(hit, 0, size)
            whole = live[hit & (size + 1 == self.width)]
            found[at[whole]] = lo[whole]
            live = live[at[live] > stop[live]]
        return found
