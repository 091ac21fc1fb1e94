"""Words and word-shingle sets as the training-data operators define them.

Words are the maximal runs of letters and digits (Unicode categories L and N) of a text after NFKC and
full case folding. Texts are worked on whole, a record batch at a time, in Arrow-fed Python: Spark has no
NFKC or case folding of its own.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import regex

from quern.functions.hashing import WordHashes, mix, shingles  # noqa: F401

#: ``[^\W_]`` is exactly the categories L and N (tested over all code points).
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def words(text: str) -> list[str]:
    return WORD.findall(fold(text))


#: Places at which a text may be cut so that the parts fold as the whole does: clusters, else before ASCII that is no letter or digit.
_CUTS = (regex.compile(r"\X").findall, regex.compile(r"[^\x00-/:-@\[-`{-\x7f]+|[\x00-/:-@\[-`{-\x7f][^\x00-/:-@\[-`{-\x7f]*").findall)


def word_spans(text: str) -> tuple[list[int], list[int]]:
    """Where each word of ``words(text)`` begins and ends in the text itself.

    Where folding makes several characters of what can't be cut, the whole of it counts to each of its words.
    """
    if text.isascii():
        found = [m.span() for m in WORD.finditer(text)]
        return [a for a, _ in found], [b for _, b in found]
    folded = fold(text)
    for cut in _CUTS:
        parts = cut(text)
        own = [fold(x) for x in parts]
        if "".join(own) == folded:
            break
    else:
        parts, own = [text], [folded]
    at, raw = [0, *accumulate(map(len, own))], [0, *accumulate(map(len, parts))]
    starts, ends = [], []
    for m in WORD.finditer(folded):
        starts.append(raw[bisect_right(at, m.start()) - 1])
        ends.append(raw[bisect_left(at, m.end())])
    return starts, ends


class WordHasher:
    """Hashes the words of a batch of texts into one flat array with a word count for each text."""

    def __init__(self) -> None:
        self._memo = WordHashes()

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        get, out, counts = self._memo.__getitem__, array("Q"), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = words(text)
                counts[i] = len(found)
                out.extend(map(get, found))
        return np.frombuffer(out, np.uint64) if out else np.zeros(0, np.uint64), counts


def shingle_sets(hasher: WordHasher, texts: list[str | None], width: int, min_words: int) -> list[np.ndarray | None]:
    """For each text its sorted set of shingle hashes, or None if it has fewer than ``min_words`` words."""
    flat, counts = hasher.flat(texts)
    grams = shingles(flat, width)
    out: list[np.ndarray | None] = []
    at = 0
    for n in counts.tolist():
        out.append(np.unique(grams[at : at + n - width + 1]) if n >= max(min_words, width) else None)
        at += n
    return out
