"""Problem 3: records that differ only in form.

Merkle-style bottom-up hashing: the leaves are the normalised fields of a record, or the whole text; an
unordered node hashes the sorted digests of its children; documents are grouped by root digest. Groups of
two and more are then confirmed by comparing their whole normalised structures.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.sketch import Membership
from quern.llm.words import mix, words
from quern.plans.runtime import materialize, spread

DIGEST_BYTES = 16
#: Most bytes of the broadcast filter of the documents in groups. Beyond it more single documents are compared.
FILTER_BYTES = 1 << 25
#: A group of more than this share of all rows is joined by broadcast; there are at most as many such groups.
HEAVY_SHARE = 1000

_NAME = re.compile(r"[^:=|;{}]{1,30}")
_LINES = re.compile(r"\r\n|\r|\n")
_PARTS = re.compile(r"[;|]")


def _named(part: str, sign: str) -> tuple[str, str] | None:
    name, found, value = part.partition(sign)
    name, value = name.strip(), value.strip()
    return (name, value) if found and value and _NAME.fullmatch(name) else None


def _all_named(parts: list[str], sign: str) -> list[tuple[str, str]] | None:
    out = []
    for p in parts:
        if (x := _named(p, sign)) is None:
            return None
        out.append(x)
    return out if len(out) >= 2 else None


def fields(text: str) -> list[tuple[str, str]] | None:
    """The (name, value) pairs of a field record in any of its notations, else None."""
    s = text.strip()
    if s[:1] == "{":
        if s[-1:] == "}":
            try:
                pairs = json.loads(s, object_pairs_hook=list)
            except (ValueError, RecursionError):
                return None
            if isinstance(pairs, list) and len(pairs) >= 2 and all(isinstance(v, str) and v.strip() and _NAME.fullmatch(k.strip()) for k, v in pairs):
                return [(k.strip(), v.strip()) for k, v in pairs]
        return None
    if ":" not in s and "=" not in s:
        return None
    lines = [x for x in _LINES.split(s) if x.strip()]
    if len(lines) >= 2:
        return _all_named(lines, ":")
    return _all_named(_PARTS.split(s), "=")


def structure(text: str | None) -> tuple[str, ...] | None:
    """The normalised structure: ("t", word string), or ("r", field strings in order); None if there is no word."""
    if not text:
        return None
    if (found := fields(text)) is not None:
        leaves = sorted("".join(words(f"{k} {v}")) for k, v in found)
        return ("r", *leaves) if any(leaves) else None
    leaf = "".join(words(text))
    return ("t", leaf) if leaf else None


def root_digest(node: tuple[str, ...], size: int = DIGEST_BYTES) -> bytes:
    kind, *leaves = node
    children = sorted(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=size).digest() for x in leaves)
    return blake2b(kind.encode() + b"".join(children), digest_size=size).digest()


def _digests(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(d, root_digest(s, size)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (s := structure(t))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["doc_id", "digest"])

    return run


def _id_hashes(b: pa.RecordBatch) -> np.ndarray:
    return mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(1))


def _structures(grouped, size: int):
    """Structures of the documents that the filter may hold; the others are not read again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Membership(grouped.value)
        for b in batches:
            b = b.filter(pa.array(index.might_contain(_id_hashes(b))))
            found = [(d, root_digest(s, size), s) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (s := structure(t))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.binary()), pa.array(["\x1f".join(s) for _, _, s in found], pa.string())], names=["doc_id", "digest", "structure"])

    return run


def _of_groups(rows: DataFrame, groups: DataFrame, size: str, total: int) -> DataFrame:
    """``rows`` joined to ``groups`` by digest; those of the few groups with more than a ``HEAVY_SHARE``-th of ``total`` rows where they lie."""
    heavy = F.col(size) * HEAVY_SHARE > total
    return rows.join(groups.where(~heavy).drop(size), "digest").unionByName(rows.join(F.broadcast(groups.where(heavy).drop(size)), "digest"))


def form_copies(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, DataFrame]:
    """(groups, members): groups has keep_id and copies of each group of two or more, members each other document's doc_id with its keep_id.

    Null texts and texts without a word belong to no group, so they are in neither table; so do rows with a
    null id. An empty table gives two empty tables. Other columns of the input play no part.
    """
    spark = documents.sparkSession
    own = spread(documents, id_col).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    thin = materialize(own.mapInArrow(_digests(digest_bytes), "doc_id bigint, digest binary"), "p3-digests")
    repeated = materialize(thin.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "p3-repeated")
    total = thin.count()
    grouped = materialize(_of_groups(thin, repeated, "n", total), "p3-grouped")
    index = spark.sparkContext.broadcast(Membership.build(grouped.select("doc_id"), grouped.count(), _id_hashes, filter_bytes).bits)

    compared = own.mapInArrow(_structures(index, digest_bytes), "doc_id bigint, digest binary, structure string")
    confirmed = compared.groupBy("digest", "structure").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    # one digest with two structures is a collision; its structure is then kept to tell the groups apart
    shapes = confirmed.groupBy("digest").agg(F.count(F.lit(1)).alias("shapes"), F.collect_list(F.struct("keep_id", "copies", "structure")).alias("each"))
    shapes = shapes.select("digest", "shapes", F.explode("each").alias("x")).select("digest", "shapes", "x.keep_id", "x.copies", F.when(F.col("shapes") > 1, F.col("x.structure")).alias("structure"))
    groups = materialize(shapes.where("copies > 1"), "p3-groups")

    plain, mixed = groups.where("shapes = 1"), groups.where("shapes > 1")
    members = _of_groups(grouped, plain.select("digest", "keep_id", "copies"), "copies", total)
    if not mixed.isEmpty():
        members = members.unionByName(compared.join(mixed.select("digest", "structure", "keep_id"), ["digest", "structure"]).select("digest", "doc_id", "keep_id"))
    return groups.select("keep_id", "copies"), members.where("doc_id <> keep_id").select("keep_id", "doc_id")
