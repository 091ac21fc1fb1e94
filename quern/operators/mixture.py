"""Two ordered sources mixed by whole documents to a ratio, without repeating a document.

The sequential rule, draw from the source that is furthest behind its target and skip what is owned already,
is a merge of two sorted lists: a document's key is the tokens its source contributed before it, scaled by the
other source's target. Ownership of a document that both sources have depends on the keys and the keys on who
lost it, so these documents alone are merged one after another, as the rule says, in blocks of slim metadata;
all other rows get their keys from prefix sums. Texts and ids play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import running_total
from quern.plans.runtime import materialize, shared_dir

#: Shared documents of a source that the driver holds at once, besides a byte for each of all.
BLOCK = 500_000


ORDER = ["ordinal", "doc_id"]


def _key(before: Column, scale: tuple[int, int]) -> Column:
    """The key of a row from the ids its source stored before it; the very first id stored, the first source's, is no prediction."""
    first = F.col("src") == 0
    return F.when(first, F.greatest(before - 1, F.lit(0)) * scale[0]).otherwise(before * scale[1])


def _side(shared: DataFrame, src: int, n: int) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """The shared documents of a source in its order, by blocks: (place in the first source, all_before, stored) of each."""
    for start in range(0, n, BLOCK):
        t = shared.where((F.col("src") == src) & F.col("pos").between(start, start + BLOCK - 1)).select("pos", "twin", "all_before", "stored").toArrow().sort_by("pos")
        yield tuple(t.column(c).to_pylist() for c in ("twin", "all_before", "stored"))


def _lost(sides: list[Iterator[tuple[list[int], list[int], list[int]]]], n: int, scale: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(source, places in its order) of the documents that the other source drew before, a block at a time.

    The sequential rule on the ``n`` documents that both sources have; a place is a document's number in its source's order.
    """
    drawn = bytearray(n)
    taken, done = [0, 0], [0, 0]  # ids lost so far; places before the block
    block = [next(s, None) for s in sides]
    flags = [bytearray(len(b[0])) if b else bytearray() for b in block]
    at = [0, 0]
    while block[0] and block[1]:
        (twin_0, all_0, stored_0), (twin_1, all_1, stored_1) = block
        (lost_0, lost_1), (i, j), (off_0, off_1) = flags, at, taken
        end_0, end_1 = len(twin_0), len(twin_1)
        while i < end_0 and j < end_1:
            if max(all_0[i] - off_0 - 1, 0) * scale[0] <= (all_1[j] - off_1) * scale[1]:
                if drawn[twin_0[i]]:
                    lost_0[i] = 1
                    off_0 += stored_0[i]
                else:
                    drawn[twin_0[i]] = 1
                i += 1
            else:
                if drawn[twin_1[j]]:
                    lost_1[j] = 1
                    off_1 += stored_1[j]
                else:
                    drawn[twin_1[j]] = 1
                j += 1
        at, taken = [i, j], [off_0, off_1]
        for s in (0, 1):
            if at[s] == len(block[s][0]):
                yield s, done[s] + np.flatnonzero(np.frombuffer(flags[s], np.uint8))
                done[s] += at[s]
                block[s], at[s] = next(sides[s], None), 0
                flags[s] = bytearray(len(block[s][0])) if block[s] else bytearray()
    for s in (0, 1):  # the other source is through, so it has drawn all that are left here
        if block[s]:
            flags[s][at[s] :] = b"\1" * (len(flags[s]) - at[s])
            yield s, done[s] + np.flatnonzero(np.frombuffer(flags[s], np.uint8))
            for start in range(done[s] + len(flags[s]), n, BLOCK):
                yield s, np.arange(start, min(n, start + BLOCK))


def _losses(shared: DataFrame, scale: tuple[int, int]) -> DataFrame:
    """(src, document_id, lost) of what the other source drew before, of the documents that both have.

    Up to ``BLOCK`` of them the driver takes as they are; more are numbered and written, and it takes them by blocks.
    """
    spark = shared.sparkSession
    few = shared.limit(2 * BLOCK + 1).toArrow()
    if few.num_rows <= 2 * BLOCK:
        few = few.take(pc.sort_indices(few, [(c, "ascending") for c in ("src", *ORDER)], null_placement="at_start"))
        n = few.num_rows // 2
        ids = few["document_id"].to_pylist()
        twin = {d: k for k, d in enumerate(ids[:n])}
        sides = [iter([([twin[d] for d in ids[s * n : s * n + n]], few["all_before"][s * n : s * n + n].to_pylist(), few["stored"][s * n : s * n + n].to_pylist())] if n else []) for s in (0, 1)]
        gone = [(s, ids[s * n + k]) for s, places in _lost(sides, n, scale) for k in places.tolist()]
        found = pa.table({"src": pa.array([s for s, _ in gone], pa.int32()), "document_id": pa.array([d for _, d in gone], pa.string()), "lost": pa.array([True] * len(gone), pa.bool_())})
        return F.broadcast(spark.createDataFrame(found, "src int, document_id string, lost boolean"))
    numbered = running_total(shared.withColumn("one", F.lit(1).cast("bigint")), "one", ORDER, "pos", by=["src"], label="mixture-places")
    twins = numbered.where("src = 0").select("document_id", F.col("pos").alias("twin"))
    rows = numbered.join(twins, "document_id").select("src", "pos", "twin", "all_before", "stored", "document_id")
    rows = materialize(rows.repartitionByRange("src", "pos").sortWithinPartitions("src", "pos"), "mixture-shared")
    n = rows.where("src = 0").count()
    path = f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}-mixture-lost-{uuid.uuid4().hex}"
    spark.createDataFrame([], "src int, pos bigint").write.parquet(path)
    for src, pos in _lost([_side(rows, s, n) for s in (0, 1)], n, scale):
        if len(pos):
            spark.createDataFrame(pa.table({"src": np.full(len(pos), src, np.int32), "pos": pos.astype(np.int64)})).write.mode("append").parquet(path)
    return spark.read.schema("src int, pos bigint").parquet(path).join(rows, ["src", "pos"]).select("src", "document_id", F.lit(True).alias("lost"))


def check_plan(sources: tuple[str, ...], order: tuple[str, ...], targets: tuple[int, ...], stored_total: int) -> None:
    """The sources in their fixed order, a positive target of predictions for each, and stored ids of one more than all; else an error."""
    if tuple(sources) != tuple(order):
        raise ValueError(f"sources {sources} are not {order}, in this order")
    if len(targets) != len(order) or min(targets, default=0) <= 0:
        raise ValueError("each source has a positive target")
    if stored_total != sum(targets) + 1:
        raise ValueError(f"{stored_total} stored ids are not the targets' {sum(targets)} and one")


def merge(rows: DataFrame, targets: tuple[int, int], start: tuple[int, int] = (0, 0)) -> DataFrame:
    """(src 0 or 1, ordinal, doc_id, document_id, n_tokens) -> the first row of each document in each source, with stored, kept, key, owner, and the key its source goes on with (after).

    ``kept`` rows, in the order (key, src, ordinal, doc_id), are the mixture. (src, ordinal, doc_id) must be unique.
    ``start`` are the ids each source has stored before, in a mixture that goes on.
    Later copies take no part, however many a document has. All rows are ordered twice, once before and once
    after ownership is settled; in between, only documents that both sources have are merged, each once.
    """
    spark = rows.sparkSession
    g = gcd(*targets)
    scale = (targets[1] // g, targets[0] // g)
    place = F.struct(*ORDER)
    firsts = rows.groupBy("document_id", "src").agg(F.min(place).alias("place"), F.min_by((F.col("n_tokens") + 1).cast("bigint"), place).alias("stored"))
    sides = firsts.groupBy("document_id").agg((F.count(F.lit(1)) == 2).alias("shared"))
    marked = firsts.join(sides, "document_id").select("src", "place.ordinal", "place.doc_id", "document_id", "stored", "shared")
    stored_before = F.when(F.col("src") == 0, F.lit(start[0])).otherwise(F.lit(start[1])).cast("bigint")
    everything = running_total(marked, "stored", ORDER, "all_before", by=["src"], label="mixture").withColumn("all_before", F.col("all_before") + stored_before)
    # all rows count at first; what a source loses is then taken off
    lost = _losses(everything.where("shared").select("src", *ORDER, "document_id", "all_before", "stored"), scale)
    own = everything.join(lost, ["src", "document_id"], "left").withColumn("kept", F.col("lost").isNull()).withColumn("owner", F.when(F.col("kept"), F.col("src")).otherwise(1 - F.col("src")))
    own = own.select("src", *ORDER, "document_id", "stored", "kept", "owner", F.when(F.col("kept"), F.col("stored")).otherwise(F.lit(0)).cast("bigint").alias("add"))
    return running_total(own, "add", ORDER, "before", by=["src"], label="mixture-keys").withColumn("before", F.col("before") + stored_before).withColumn("key", _key(F.col("before"), scale)).withColumn("after", _key(F.col("before") + F.col("add"), scale)).drop("add", "before")


def _cut(merged: DataFrame, stored_total: int, start: tuple[int, int]) -> DataFrame:
    kept = running_total(merged.where("kept"), "stored", ["key", "src", "ordinal", "doc_id"], "off", label="emission").withColumn("off", F.col("off") + sum(start))
    return materialize(kept.where(F.col("off") < stored_total), "emission-cut")


def emission(merged: DataFrame, stored_total: int, start: tuple[int, int] = (0, 0), targets: tuple[int, int] | None = None) -> DataFrame:
    """The mixture's documents in order: off is the place of the first stored id, n the ids stored, the last one cut exactly.

    A source that ends before the total is reached is an error; it is never replaced by the other.
    """
    cut = _cut(merged, stored_total, start)
    ended, end = _ended(merged, cut, targets, start)
    if ended:
        raise RuntimeError(f"source {ended[0]} ended before the mixture was complete")
    if end < stored_total:
        raise RuntimeError("both sources ended before the mixture was complete")
    return cut.withColumn("n", F.least(F.col("stored"), F.lit(stored_total) - F.col("off")))


def first_to_end(merged: DataFrame, stored_total: int) -> DataFrame:
    """(src) of the source whose turn came when it had no document left, before ``stored_total``; no row if the mixture is complete."""
    ended, end = _ended(merged, _cut(merged, stored_total, (0, 0)))
    after = _after(merged)
    turns = sorted((after.get(s, 0), s) for s in (0, 1))  # the keys at which each would draw what it hasn't
    return merged.sparkSession.createDataFrame([] if end >= stored_total and not ended else [(turns[0][1],)], "src int")


def _after(merged: DataFrame) -> dict[int, int]:
    """The key each source goes on with behind its last document."""
    return {r.src: r.key for r in merged.where("kept").groupBy("src").agg(F.max("after").alias("key")).collect()}  # two sources


def _ended(merged: DataFrame, emitted: DataFrame, targets: tuple[int, int] | None = None, start: tuple[int, int] = (0, 0)) -> tuple[list[int], int]:
    """Sources whose turn came when they had nothing left, and the ids stored behind the last document, uncut."""
    last, end = emitted.agg(F.max(F.struct("key", "src")).alias("last"), F.max(F.col("off") + F.col("stored"))).first()
    if last is None:
        return [], sum(start)
    begin = [0, 0]
    if targets and sum(start):  # a source that has nothing more ended where the part before stopped
        g = gcd(*targets)
        begin = [max(start[0] - 1, 0) * targets[1] // g, start[1] * targets[0] // g]
    after = _after(merged)
    return [s for s in (0, 1) if (after.get(s, begin[s]), s) < (last.key, last.src)], end


def exhausted(merged: DataFrame, emitted: DataFrame, targets: tuple[int, int] | None = None, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """Sources whose turn came, before the last emitted document, when they had none left; also one that has no documents at all.

    The keys of ``merged`` are by its own targets; ``targets`` are only needed with a ``start``.
    """
    return merged.sparkSession.createDataFrame([(s,) for s in _ended(merged, emitted, targets, start)[0]], "src int")


def state(emitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a mixture needs to go on: (document_id, src) of the documents it has whole, and of each source the ids stored in them and the place of the last."""
    whole = emitted.where(F.col("n") == F.col("stored"))
    places = whole.groupBy("src").agg(F.sum("n").alias("stored_ids"), F.max(F.struct(*ORDER)).alias("last"))
    return whole.select("document_id", "src"), places.select("src", "stored_ids", "last.ordinal", "last.doc_id")


def extend(rows: DataFrame, owned: DataFrame, places: DataFrame, targets: tuple[int, int], stored_total: int) -> DataFrame:
    """The rest of a mixture up to ``stored_total``, from a state: with what came before it is what all rows at once would give.

    ``rows`` may have more documents behind those of before, and the targets the same ratio. A document that was cut is stored anew, whole.
    """
    at = {r.src: r for r in places.collect()}  # two sources
    start = tuple(int(at[s].stored_ids) if s in at else 0 for s in (0, 1))
    place = F.struct(*(F.col(c).cast("bigint").alias(c) for c in ORDER))
    rest = rows
    for s, r in at.items():
        rest = rest.where((F.col("src") != s) | (place > F.struct(F.lit(r.ordinal).cast("bigint").alias("ordinal"), F.lit(r.doc_id).cast("bigint").alias("doc_id"))))
    merged = materialize(merge(rest.join(owned.select("document_id"), "document_id", "left_anti"), targets, start), "mixture-rest")
    return emission(merged, stored_total, start, targets)


def accounting(rows: DataFrame, merged: DataFrame, emitted: DataFrame) -> DataFrame:
    """By source: stored and prediction ids, documents, and rows skipped as copies from the source itself or the other.

    ``rows`` are those the mixture was made of. A row was drawn if it doesn't stand behind the last emitted
    document of its source; of the drawn, those not emitted were skipped, for the source that owns the document.
    """
    place = F.struct("ordinal", "doc_id")
    last = emitted.groupBy("src").agg(F.max(place).alias("last"))
    drawn = rows.join(F.broadcast(last), "src").where(place <= F.col("last")).groupBy("src", "document_id").agg(F.count(F.lit(1)).alias("times"))
    lost = merged.where(~F.col("kept")).select("src", "document_id", F.lit(True).alias("lost"))
    by = drawn.join(lost, ["src", "document_id"], "left").groupBy("src").agg(F.sum("times").alias("rows"), F.coalesce(F.sum(F.when(F.col("lost"), F.col("times"))), F.lit(0)).alias("cross_skips"))
    used = emitted.groupBy("src").agg(F.sum("n").alias("stored_ids"), (F.sum("n") - F.count_if(F.col("off") == 0)).alias("prediction_ids"), F.count(F.lit(1)).alias("documents"))
    return used.join(by, "src").withColumn("intra_skips", F.col("rows") - F.col("documents") - F.col("cross_skips")).drop("rows")


def first_in_source(rows: DataFrame) -> DataFrame:
    """Rows that are the first of their document_id within their source; combined before they are shuffled, so a document with many copies is no burden."""
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in ("source", "document_id")]), F.struct("ordinal", "doc_id"))
    return rows.groupBy("source", "document_id").agg(first.alias("_x")).select("source", "document_id", "_x.*")
