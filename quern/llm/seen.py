"""Problem 6: has this key been seen before?

Filter, then verify. Keys are brought to shards by hash, as many as the number of keys asks for, and lie there on disk
in order of key. Each shard's task feeds its arrivals, in order, to a Bloom filter of its own, which is all it holds in
memory: an arrival with a bit not set before is new and decided at once. The rest are looked up among the full keys of
their shard, which needs no further shuffle, and each one disproved there is counted as a wrong answer of the filter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import sketch
from quern.llm.words import mix
from quern.plans.runtime import materialize_bucketed

#: Keys of a shard, about, and the bits of its filter for each, before rounding up; the filter has a bit at PROBES places for a key.
SHARD_KEYS, KEY_BITS, PROBES = 1 << 20, 12, 3
#: Most bytes of a shard's filter. A smaller one has more arrivals verified; answers don't change.
FILTER_BYTES = 1 << 25
KEY_BYTES = 32

NEW, POSITIVE, REPEAT = 0, 2, 3


def _hash(keys: pa.Array) -> np.ndarray:
    """64-bit hash of each fixed-width key."""
    parts = np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, KEY_BYTES // 8)
    h = np.zeros(len(parts), np.uint64)
    for k in range(parts.shape[1]):
        h = mix(h ^ parts[:, k])
    return h


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((h + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)


def _collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a batch the later arrivals of a key are repeats for certain.

    They go on with their row number in place of the key: a key that fills the batches is sent once for each of them.
    """
    for b in batches:
        if not b.num_rows:
            continue
        order, codes = b.column(0).to_numpy(), b.column(1).dictionary_encode().indices.to_numpy()
        at = np.lexsort((order, codes))
        later = np.zeros(len(at), bool)
        later[at[1:]] = codes[at[1:]] == codes[at[:-1]]
        numbers = pa.Array.from_buffers(pa.binary(8), len(order), [None, pa.py_buffer(order.astype(np.int64).tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), pc.if_else(pa.array(later), numbers, b.column(1))], names=["row_id", "key"])


def _probe(size: int):
    """Class of each arrival of a shard, which come in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.uint8)
        for b in batches:
            whole = pc.equal(pc.binary_length(b.column(1)), KEY_BYTES).to_numpy(zero_copy_only=False)
            h = _hash(b.column(1).filter(pa.array(whole)))
            new, touched = np.zeros(len(h), bool), []
            for at in _places(h, size * 8):
                first = np.zeros(len(h), bool)
                first[np.unique(at, return_index=True)[1]] = True
                new |= first & ((held[at >> 3] >> (at & 7)) & 1 == 0)
                touched.append(at)
            for at in touched:
                np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
            kind = np.full(len(whole), REPEAT, np.int8)
            kind[whole] = np.where(new, NEW, POSITIVE)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kind)], names=["row_id", "key", "kind"])

    return run


def decide(arrivals: DataFrame, known: DataFrame | None = None, *, filter_bytes: int = FILTER_BYTES, shard_keys: int = SHARD_KEYS, label: str = "p6") -> DataFrame:
    """(row_id, key) -> (row_id, filter_seen, seen) for each arrival with a key.

    ``arrivals`` gives a unique row_id in order of arrival and a key of 32 bytes; ``known`` the keys from before
    the first arrival. Null keys and keys of another length are no keys and get no row, nor do rows with a null
    row_id. An empty table gives no rows.
    """
    spark = arrivals.sparkSession
    rows = arrivals.select(F.col("row_id").cast("bigint").alias("row_id"), "key").where((F.octet_length("key") == KEY_BYTES) & F.col("row_id").isNotNull())
    n, low = rows.agg(F.count(F.lit(1)), F.min("row_id")).first()
    if not n:
        return spark.createDataFrame([], "row_id bigint, filter_seen boolean, seen boolean")
    if known is not None:
        before = known.where(F.octet_length("key") == KEY_BYTES)
        n += before.count()
        rows = rows.unionByName(before.select(F.lit(low - 1).alias("row_id"), "key"))
    shards = max(spark.sparkContext.defaultParallelism, -(-n // shard_keys))
    size = sketch.power_of_two(n * KEY_BITS // 8 // shards, 64, filter_bytes)
    brought = rows.mapInArrow(_collapse, "row_id bigint, key binary").repartition(shards, "key").sortWithinPartitions("row_id")
    store = materialize_bucketed(brought.mapInArrow(_probe(size), "row_id bigint, key binary, kind tinyint"), label, shards, "key")

    arrived = store.where(F.col("row_id") >= low)
    decided = arrived.where(F.col("kind") != POSITIVE).select("row_id", (F.col("kind") == REPEAT).alias("filter_seen"), (F.col("kind") == REPEAT).alias("seen"))
    # within the shards: a key comes there at most once a batch, so no group is large however often a key repeats
    firsts = store.where(F.col("kind") != REPEAT).groupBy("key").agg(F.min("row_id").alias("first"), F.max("kind").alias("most")).where(F.col("most") == POSITIVE).select("key", "first")
    verified = arrived.where(F.col("kind") == POSITIVE).join(firsts, "key").select("row_id", F.lit(True).alias("filter_seen"), (F.col("row_id") > F.col("first")).alias("seen"))
    return decided.unionByName(verified)


def document_key(document_id):
    """The 32 bytes of an id's 64 hex digits, whatever its letter case, outer blanks and leading ``sha256:``; else null."""
    digits = F.regexp_extract(document_id, r"(?iU)^\s*(?:sha256:)?\s*([0-9a-f]{64})\s*$", 1)
    return F.when(F.length(digits) == 64, F.unhex(digits))


def streams(ngram_hashes: DataFrame, ngram_index: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    return {
        "ngram": decide(ngram_hashes.select(F.col("arrival_id").alias("row_id"), F.col("value").alias("key")), ngram_index.select(F.col("value").alias("key")), label="p6-ngram"),
        "document": decide(documents.select(F.col("doc_id").alias("row_id"), document_key(F.col("document_id")).alias("key")), label="p6-document"),
    }


def found(ngram_hashes: DataFrame, ngram_index: DataFrame, documents: DataFrame) -> DataFrame:
    """(stream, row_id) of each arrival whose key came before."""
    parts = [df.where("seen").select(F.lit(name).alias("stream"), "row_id") for name, df in streams(ngram_hashes, ngram_index, documents).items()]
    return parts[0].unionByName(parts[1])


def error_rates(ngram_hashes: DataFrame, ngram_index: DataFrame, documents: DataFrame) -> DataFrame:
    """Of each stream: arrivals with a key, those the filter called seen, those that were, the disproved and their rate."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("arrivals"), F.count_if("filter_seen").alias("filter_seen"), F.count_if("seen").alias("seen"), F.count_if(F.col("filter_seen") & ~F.col("seen")).alias("wrong_seen"), F.count_if(~F.col("filter_seen") & F.col("seen")).alias("wrong_new")).select(F.lit(name).alias("stream"), "*")
        for name, df in streams(ngram_hashes, ngram_index, documents).items()
    ]
    return parts[0].unionByName(parts[1]).withColumn("wrong_rate", (F.col("wrong_seen") + F.col("wrong_new")) / F.greatest("arrivals", F.lit(1)))


def totals(ngram_hashes: DataFrame, ngram_index: DataFrame, documents: DataFrame) -> DataFrame:
    """Of each stream: arrivals with a key, those seen before, and those of them that the filter called new."""
    return error_rates(ngram_hashes, ngram_index, documents).select("stream", "arrivals", "seen", "wrong_new")
