"""The public tokenizer byte_bpe_50k: a text's pre-token words, and the ids or the number of ids of a word.

The vocabulary file is read from a folder given as a parameter; nothing is trained or copied. Special-token
strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from pathlib import Path

import numpy as np
import regex

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"

# Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words longer than this are encoded where they stand and never kept.
WORD_CHARS = 48
#: Entries of a worker's own memo before it starts afresh.
MEMO_ENTRIES = 200_000


def pieces(folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Each piece with its id."""
    lines = Path(folder, f"{NAME}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


class Encoder:
    def __init__(self, folder: str = TOKENIZERS) -> None:
        import tiktoken

        self._bpe = tiktoken.Encoding(NAME, pat_str=PATTERN, mergeable_ranks=pieces(folder), special_tokens={})
        self.split = regex.compile(PATTERN).findall
        self.spans = regex.compile(PATTERN).finditer

    def encode(self, word: str) -> list[int]:
        return self._bpe.encode_ordinary(word)

    def lengths(self, word: str) -> list[int]:
        """Bytes of each token of ``word``."""
        return [len(x) for x in self._bpe.decode_tokens_bytes(self.encode(word))]


class WordIds(dict):
    """word -> its ids as packed int32; words not in the shared table are encoded at first sight."""

    def __init__(self, encoder: Encoder, table: dict[str, bytes] | None = None) -> None:
        super().__init__(table or {})
        self._encoder, self._table = encoder, table or {}
        self._most = len(self._table) + MEMO_ENTRIES

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self._encoder.encode(word), np.int32).tobytes()
        if len(word) <= WORD_CHARS:
            if len(self) >= self._most:
                self.clear()
                self.update(self._table)
            self[word] = ids
        return ids


class WordCounts(dict):
    """word -> number of its ids."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self._encoder = encoder

    def __missing__(self, word: str) -> int:
        n = len(self._encoder.encode(word))
        if len(word) <= WORD_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = n
        return n


_ENCODERS: dict[str, Encoder] = {}


def encoder(folder: str = TOKENIZERS) -> Encoder:
    """One encoder for a worker process."""
    if folder not in _ENCODERS:
        _ENCODERS[folder] = Encoder(folder)
    return _ENCODERS[folder]
