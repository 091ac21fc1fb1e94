"""Contamination screen: a document sharing any n-gram digest with the benchmark index is rejected.

Membership is exact. An index of proven small size travels to the documents and only hits leave the scan. Of a
larger one a Bloom filter of bounded size travels; only digests that it may hold are shuffled, and joined exactly.
An index that was built here also has a quick hash of each n-gram: where that is not in the index the digest can't be, and
is never made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quern.functions import text as T
from quern.functions.hashing import mix
from quern.functions.sketch import Membership
from quern.plans.runtime import materialize

#: Most digests sent to the documents, of 32 bytes each.
SHARED_DIGESTS = 500_000
#: Most bytes of the filter of a larger index: two a digest up to 33 million. Beyond it more digests are shuffled, and answers stay exact.
FILTER_BYTES = 1 << 26


def _hashes(digests: list[bytes]) -> np.ndarray:
    """Digests are random already: their first eight bytes."""
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)[:, 0]


class _Probe:
    """The distinct digests of a text that a condition lets through."""

    def __init__(self, width: int, quick: Callable[[np.ndarray], np.ndarray] | None = None, chosen: Callable[[list[bytes]], list[bool]] | None = None) -> None:
        self._hasher, self._width, self._quick, self._chosen = T.NgramHasher(width), width, quick, chosen

    def digests(self, text: str | None) -> list[bytes]:
        if not text:
            return []
        if self._quick:
            tokens, hashes = self._hasher.read(text)
            found = list({T.ngram_digest(tokens[i : i + self._width]) for i in np.flatnonzero(self._quick(hashes)).tolist()}) if len(hashes) else []
        else:
            found = list(T.ngram_digests(text, self._width))
        return [v for v, ok in zip(found, self._chosen(found)) if ok] if self._chosen and found else found


def _grams(texts: DataFrame, probe: Callable[[], _Probe]) -> DataFrame:
    """(id, text) -> (id, value): a row for each digest of a text that the probe gives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = probe()
        for b in batches:
            found = [own.digests(t) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([v for x in found for v in x], pa.binary())], names=["id", "value"])

    own = texts.toDF("id", "text")
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, value binary")


def ngrams(texts: DataFrame, width: int = T.NGRAM_WIDTH) -> DataFrame:
    """(id, text) -> (id, value): a row for each distinct digest of a text."""
    return _grams(texts, lambda: _Probe(width))


def build_index(texts: DataFrame, width: int = T.NGRAM_WIDTH) -> DataFrame:
    """Distinct digests of all texts of (id, text), as value, each with its quick hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = T.NgramHasher(width)
        for b in batches:
            found = {}
            for text in b.column(0).to_pylist():
                if text:
                    tokens, hashes = hasher.read(text)
                    found |= {T.ngram_digest(tokens[i : i + width]): h for i, h in enumerate(hashes.view(np.int64).tolist())}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["value", "quick"])

    return texts.toDF("id", "text").select("text").mapInArrow(run, "value binary, quick bigint").distinct()


def extend_index(index: DataFrame, more: DataFrame) -> DataFrame:
    """Union into an existing index: only digests it lacks are appended."""
    new = more.select("value").distinct().join(index.select("value"), "value", "left_anti")
    return index.select("value", F.lit(False).alias("new")).unionByName(new.select("value", F.lit(True).alias("new")))


def check_index(index: DataFrame) -> DataFrame:
    """Rows that are no digest: null or not 32 bytes long."""
    return index.where(F.coalesce(F.octet_length("value") != 32, F.lit(True)))


def _probing(index: DataFrame, width: int, shared_digests: int, filter_bytes: int) -> tuple[Callable[[], _Probe], DataFrame | None]:
    """A probe for the documents, and the index that what it lets through must still be joined with, if any."""
    sc, fast = index.sparkSession.sparkContext, "quick" in index.columns
    known = index.select("value", *(["quick"] if fast else [])).where(F.octet_length("value") == 32)
    few = known.limit(shared_digests + 1).toArrow()
    if few.num_rows <= shared_digests:
        exact = sc.broadcast((frozenset(few["value"].to_pylist()), np.unique(few["quick"].to_numpy().view(np.uint64)) if fast and few.num_rows else None))

        def whole() -> _Probe:
            values, quick = exact.value
            return _Probe(width, None if quick is None else lambda h: quick[np.minimum(np.searchsorted(quick, h), len(quick) - 1)] == h, lambda found: [v in values for v in found])

        return whole, None
    known = materialize(known, "screen-index")
    hashes = (lambda b: mix(b.column(0).to_numpy().view(np.uint64))) if fast else (lambda b: _hashes(b.column(0).to_pylist()))
    bits = sc.broadcast(Membership.build(known.select("quick" if fast else "value"), known.count(), hashes, filter_bytes).bits)

    def filtered() -> _Probe:
        index = Membership(bits.value)
        return _Probe(width, lambda h: index.might_contain(mix(h))) if fast else _Probe(width, None, lambda found: index.might_contain(_hashes(found)).tolist())

    return filtered, known.select("value")


def overlaps(texts: DataFrame, index: DataFrame, width: int = T.NGRAM_WIDTH, shared_digests: int = SHARED_DIGESTS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(id, value): each distinct digest of a text that is in the index.

    Null and empty texts have no digests; values of the index that are null or no digest match nothing.
    """
    probe, rest = _probing(index, width, shared_digests, filter_bytes)
    found = _grams(texts, probe)
    return found if rest is None else found.join(rest, "value", "left_semi").select("id", "value")


def decisions(documents: DataFrame, index: DataFrame, **options) -> DataFrame:
    """A decision for each row of (id, text): rejected, overlap_count and the sorted hex overlap_hashes; none carries text."""
    hits = overlaps(documents, index, **options).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("overlap_count"), F.array_sort(F.collect_list(F.lower(F.hex("value")))).alias("overlap_hashes"))
    own = documents.toDF("id", "text").select("id")
    out = own.join(hits, "id", "left")
    return out.select("id", F.col("overlap_count").isNotNull().alias("rejected"), F.coalesce("overlap_count", F.lit(0)).alias("overlap_count"), F.coalesce("overlap_hashes", F.array().cast("array<string>")).alias("overlap_hashes"))


def screened(rows: DataFrame, index: DataFrame, text_col: str = "text", key: str = "doc_id", width: int = T.NGRAM_WIDTH, shared_digests: int = SHARED_DIGESTS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``rows`` with ``rejected`` in place of their text, in one scan. With an index too large to share, only rows the filter calls suspicious are looked up; ``key`` must then be unique."""
    probe, rest = _probing(index, width, shared_digests, filter_bytes)
    kept = [c for c in rows.columns if c != text_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = probe()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k + 1) for k in range(len(kept))), pa.array([bool(own.digests(t)) for t in b.column(0).to_pylist()], pa.bool_())], names=[*kept, "rejected"])

    if rest is None:
        return rows.select(text_col, *kept).mapInArrow(run, StructType([*rows.select(*kept).schema, StructField("rejected", BooleanType())]))
    bad = _grams(rows.select(key, text_col), probe).join(rest, "value", "left_semi").select(F.col("id").alias(key)).distinct().withColumn("_hit", F.lit(True))
    return rows.drop(text_col).join(bad, key, "left").withColumn("rejected", F.coalesce("_hit", F.lit(False))).drop("_hit")


def counters(screened_rows: DataFrame) -> DataFrame:
    """By source: scanned, accepted (before the split), rejected, and accepted rows that went to validation."""
    ok = ~F.col("rejected")
    return screened_rows.groupBy("source").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(ok).alias("accepted"), F.count_if("rejected").alias("rejected"), F.count_if(ok & (F.col("split") == "validation")).alias("validation_excluded"))
