"""64-bit hashes of words and of runs of words, a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries kept in a word-to-hash memo before it starts afresh; bounds a worker's memory, not the result.
MEMO_ENTRIES = 1_000_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S = np.uint64(29)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> _S)) * _A
    h = (h ^ (h >> _S)) * _B
    return h ^ (h >> _S)


def shingles(flat: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` consecutive entries, order-sensitive."""
    n = len(flat) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = flat[:n] * _A
    for k in range(1, width):
        h = ((h ^ (h >> _S)) + flat[k : k + n]) * _C
    return mix(h)


class WordHashes(dict):
    """word -> 64-bit hash, computed at the first sight of a word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h
