"""Tokenizing with a given vocabulary file: pre-tokens, ids, and the checks made before a file is used.

Vocabularies are never trained here. Any function from a list of texts to lists of ids can stand in for a file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the published split pattern of byte-level BPE.
PRETOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pretokens(text: Column) -> Column:
    """The pieces that byte-level BPE never merges across; together they are the text."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def load(path: str, sha256: str | None = None, end: str | None = None):
    """A tokenizer file, its digest checked first; ``end`` must be one of its tokens."""
    from tokenizers import Tokenizer

    data = Path(path).read_bytes()
    if sha256 is not None and (found := hashlib.sha256(data).hexdigest()) != sha256:
        raise RuntimeError(f"{path} has digest {found}, not {sha256}")
    out = Tokenizer.from_str(data.decode())
    if end is not None and out.token_to_id(end) is None:
        raise RuntimeError(f"{path} has no token {end}")
    return out


def end_id(path: str, end: str) -> int:
    return load(path, end=end).token_to_id(end)


def from_file(path: str, sha256: str | None = None, specials_are_text: bool = False) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of a tokenizer file, loaded once a task. By default a special token written in a text is that token."""
    load(path, sha256)
    held = {}

    def encode(texts: list[str]) -> list[list[int]]:
        if "t" not in held:
            held["t"] = load(path, sha256)
            held["t"].encode_special_tokens = specials_are_text
        return [x.ids for x in held["t"].encode_batch(texts, add_special_tokens=False)]

    return encode


def encode(rows: DataFrame, encoder: Callable[[list[str]], list[list[int]]], text_col: str = "text") -> DataFrame:
    """``rows`` with ``ids`` in place of the text. A null text has null ids, an empty one none."""
    kept = [c for c in rows.columns if c != text_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            known = iter(encoder([t for t in texts if t is not None]))
            ids = [None if t is None else next(known) for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(k + 1) for k in range(len(kept))), pa.array(ids, pa.list_(pa.int32()))], names=[*kept, "ids"])

    own = rows.select(text_col, *kept)
    return own.mapInArrow(run, T.StructType([*rows.select(*kept).schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def vocabulary_size(path: str) -> int:
    """Ids, special tokens included."""
    return load(path).get_vocab_size()
