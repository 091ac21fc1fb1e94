"""Document identity, hash split and n-gram digests.

Identity and split are column expressions. NFC, NFKC and case folding have no Spark built-in, so they run in
Arrow-fed Python; NFC only where a text has a character that it could change.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.hashing import WordHashes, shingles

# They decide ids, splits and digests.
SPLIT_SEED, SPLIT_MODULUS, SPLIT_CUTOFF = 42, 10_000, 200
NGRAM_WIDTH = 13
NGRAM_JOINER = "␟"
NGRAM_TOKEN = re.compile(r"\w+|[^\w\s]")

_UNICODE_BLANK = r"[\s\x1c-\x1f]"


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def is_text(text: Column) -> Column:
    """Neither null nor made of Unicode white space alone."""
    return text.isNotNull() & text.rlike(r"(?U)[^\s\x1c-\x1f]")


def canonical_text(text: Column) -> Column:
    """NFC with every line break as a line feed. Characters below U+0300 are never changed by NFC."""
    # the others cross to Python as nulls, for Spark feeds a UDF every row whatever stands around it
    composed = F.coalesce(F.pandas_udf(_nfc, "string")(F.when(text.rlike(r"[^\x00-˿]"), text)), text)
    return F.regexp_replace(composed, r"\r\n?", "\n")


def document_id(text: Column) -> Column:
    """Lower-case hex SHA-256 of the canonical text."""
    return F.sha2(canonical_text(text), 256)


def split_bucket(document_id: Column, seed: int = SPLIT_SEED, modulus: int = SPLIT_MODULUS) -> Column:
    """SHA-256 of ``seed:id`` as a 256-bit number, modulo ``modulus``: its hex digits thirteen at a time, highest first.

    Written out rather than as a higher-order function, which Spark would interpret instead of compiling.
    """
    if not 0 < modulus < 1 << 31:
        raise ValueError("modulus must be positive and below 2^31")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), document_id), 256)
    out = F.lit(0).cast("bigint")
    for at in range(0, 64, 13):
        n = min(13, 64 - at)
        digits = F.pmod(F.conv(F.substring(digest, at + 1, n), 16, 10).cast("bigint"), F.lit(modulus).cast("bigint"))
        out = F.pmod(out * F.lit(16**n % modulus).cast("bigint") + digits, F.lit(modulus).cast("bigint"))
    return F.when(document_id.isNotNull(), out)


def hash_split(document_id: Column, seed: int = SPLIT_SEED, modulus: int = SPLIT_MODULUS, cutoff: int = SPLIT_CUTOFF) -> Column:
    return F.when(split_bucket(document_id, seed, modulus) < cutoff, "validation").otherwise("train")


def normalize_for_ngrams(text: str) -> list[str]:
    return NGRAM_TOKEN.findall(unicodedata.normalize("NFKC", text).casefold())


def ngram_digests(text: str, width: int = NGRAM_WIDTH) -> set[bytes]:
    """SHA-256 of each run of ``width`` tokens; none if the text has fewer."""
    tokens = normalize_for_ngrams(text)
    return {ngram_digest(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}


def ngram_digest(tokens: list[str]) -> bytes:
    return sha256(NGRAM_JOINER.join(tokens).encode("utf-8", "surrogatepass")).digest()


class NgramHasher:
    """Hashes of the runs of ``width`` tokens of a text: the same tokens have the same hash."""

    def __init__(self, width: int = NGRAM_WIDTH) -> None:
        self.width, self._get = width, WordHashes().__getitem__

    def read(self, text: str) -> tuple[list[str], np.ndarray]:
        tokens = normalize_for_ngrams(text)
        return tokens, shingles(np.fromiter(map(self._get, tokens), np.uint64, len(tokens)), self.width)


def source_text_digest(texts: DataFrame) -> DataFrame:
    """(id, text) -> (id, digest): SHA-256 of the normalised tokens joined by one space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [None if t is None else sha256(" ".join(normalize_for_ngrams(t)).encode("utf-8", "surrogatepass")).hexdigest() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string())], names=["id", "digest"])

    own = texts.toDF("id", "text")
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, digest string")


def size_metrics(text: Column, n_tokens: Column | None = None) -> dict[str, Column]:
    """UTF-8 bytes, characters, words (runs without white space), and bytes and characters a word; with the tokens there are, also a token, and tokens a word."""
    words = F.size(F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))
    one = F.greatest(words, F.lit(1))
    own = {}
    if n_tokens is not None:
        token = F.greatest(n_tokens, F.lit(1))
        own = {"bytes_per_token": F.octet_length(text) / token, "chars_per_token": F.length(text) / token, "tokens_per_word": n_tokens / one}
    return own | {"n_bytes": F.octet_length(text), "n_chars": F.length(text), "n_words": words, "bytes_per_word": F.octet_length(text) / one, "chars_per_word": F.length(text) / one}


def timestamp_filename(stamp: Column) -> Column:
    return F.translate(stamp, ":+", "-_")


def is_commit(revision: Column) -> Column:
    return revision.rlike(r"\A[0-9a-f]{40}\z")
