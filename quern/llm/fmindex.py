"""A full-text index over integer sequences: suffix array by prefix doubling, BWT in a wavelet matrix,
backward search and location through sampled suffix positions. Everything is vectorised over numpy arrays,
so many patterns are searched at once.

Symbol 0 separates sequences; separators differ from each other in the order, so no match and no
comparison runs across one.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``s`` in order; ``s`` must end with a separator."""
    n = len(s)
    sep = s == 0
    n_sep = int(sep.sum())
    rank = s.astype(np.int64) + n_sep
    rank[sep] = np.arange(n_sep)
    nxt = np.append(rank[1:], 0)
    top = int(rank.max()) + 2
    key = rank * top + np.where(sep, 0, nxt)
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sizes = np.diff(np.append(starts, n))
    rank[sa] = np.repeat(starts, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in sa whose order isn't settled
    h = 2
    while len(slots):
        u = sa[slots]
        first, second = rank[u], rank[u + h]  # u + h is inside: what is unsettled agrees for h places, without a separator
        order = np.lexsort((second, first))
        u, first, second = u[order], first[order], second[order]
        sa[slots] = u
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(u)))
        rank[u] = np.repeat(slots[starts], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa


class WaveletMatrix:
    """Rank over an integer sequence, a bit vector a level."""

    def __init__(self, s: np.ndarray, top: int) -> None:
        self.levels, self.n = max(1, int(top).bit_length()), len(s)
        self.words, self.counts, self.zeros = [], [], []
        s = s.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bits = (s >> level) & 1
            packed = np.packbits(bits.astype(bool), bitorder="little")
            w = np.zeros(self.n // 64 + 1, np.uint64)
            w.view(np.uint8)[: len(packed)] = packed
            self.words.append(w)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(w), dtype=np.int64)))
            one = bits.astype(bool)
            self.zeros.append(self.n - int(one.sum()))
            s = np.concatenate([s[~one], s[one]])
        self.base = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.words[level][block] & below)

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self._ones(level, i)
            i = np.where((c >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c occurs before each i."""
        return self._descend(c, i) - self.base[c]

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for level in range(self.levels):
            bit = ((self.words[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, i)
            i = np.where(bit, self.zeros[level] + ones, i - ones)
            c = (c << 1) | bit
        return c


class FMIndex:
    def __init__(self, s: np.ndarray, top: int) -> None:
        """``s``: symbols 1..top with separators 0 between sequences and at the end."""
        sa = suffix_array(s)
        self.tree = WaveletMatrix(s[sa - 1], top)
        self.before = np.append(0, np.cumsum(np.bincount(s, minlength=top + 1)))  # symbols smaller than c
        # sampled: every SAMPLE-th position, and the first of each sequence, so that no walk meets a separator
        marked = (np.arange(len(s)) % SAMPLE == 0) | (np.append(0, s[:-1]) == 0)
        at = marked[sa]
        self.sampled = WaveletMatrix(at.astype(np.int32), 1)
        self.positions = sa[at]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``patterns`` the half-open range of suffixes that begin with it."""
        n, width = patterns.shape
        return self.search_at(patterns.ravel(), np.arange(n) * width, width)

    def search_at(self, flat: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for the runs of ``width`` symbols of ``flat`` that begin at ``starts``."""
        n = len(starts)
        low, high = np.zeros(n, np.int64), np.full(n, self.tree.n, np.int64)
        alive = np.arange(n)
        for k in range(width - 1, -1, -1):
            c = flat[starts[alive] + k].astype(np.int64)
            low[alive] = self.before[c] + self.tree.rank(c, low[alive])
            high[alive] = self.before[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        dead = np.ones(n, bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at the places ``i`` of the order."""
        i, steps = i.copy(), np.zeros(len(i), np.int64)
        out = np.full(len(i), -1, np.int64)
        todo = np.arange(len(i))
        while len(todo):
            at = i[todo]
            hit = self.sampled.access(at) == 1
            got = todo[hit]
            out[got] = self.positions[self.sampled.rank(np.ones(len(got), np.int64), i[got])] + steps[got]
            todo, at = todo[~hit], at[~hit]
            c = self.tree.access(at)
            i[todo] = self.before[c] + self.tree.rank(c, at)
            steps[todo] += 1
        return out
