"""The stored stream: documents end to end with an end-of-document id each, seen as windows of fixed stride.

A document is never exploded into tokens: it is cut into the few pieces that windows take from it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import running_total

CONTEXT = 512


def with_end(ids, eod: int):
    return F.concat(ids, F.array(F.lit(eod)))


def offsets(documents: DataFrame, eod: int = 0, stored_total: int | None = None) -> DataFrame:
    """(seq, ids, ...) -> with ``off``, the place of the first stored id, and ``ids`` ended by ``eod``.

    Rows with null ids are no documents; of rows delivered twice the first by content stands. With ``stored_total``
    the stream is cut there, within a document if need be.
    """
    own = documents.where("ids is not null").dropDuplicates(["seq"]).withColumn("ids", with_end(F.col("ids"), eod)).withColumn("n", F.size("ids").cast("bigint"))
    # only lengths take part in the prefix sum
    placed = running_total(own.select("seq", "n"), "n", ["seq"], "off", label="stream")
    out = own.drop("n").join(placed, "seq")
    if stored_total is None:
        return out
    out = out.where(F.col("off") < stored_total)
    kept = F.least(F.col("n"), F.lit(stored_total) - F.col("off"))
    return out.withColumn("ids", F.slice("ids", F.lit(1), kept.cast("int"))).withColumn("n", kept)


def windows(stream: DataFrame, context: int = CONTEXT, wanted: DataFrame | None = None) -> DataFrame:
    """(off, n, ids) -> (window_id, ids of context + 1). The rest that fills no window is dropped.

    Window w holds the stored ids from w * context on; neighbours share one. ``wanted`` (window_id) limits the work to those.
    """
    first = F.greatest(F.lit(0), F.expr(f"(off - 1) div {context}"))
    pieces = stream.where("n > 0").select("off", "n", "ids", F.explode(F.sequence(first, F.expr(f"(off + n - 1) div {context}"))).alias("window_id"))
    if wanted is not None:
        pieces = pieces.join(wanted.select("window_id").distinct(), "window_id", "left_semi")
    start = F.greatest(F.col("off"), F.col("window_id") * context)
    stop = F.least(F.col("off") + F.col("n"), F.col("window_id") * context + context + 1)
    cut = pieces.where(start < stop).select("window_id", start.alias("at"), F.slice("ids", (start - F.col("off") + 1).cast("int"), (stop - start).cast("int")).alias("part"))
    joined = cut.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    return joined.select("window_id", F.flatten(F.transform("parts", lambda p: p.part)).alias("ids")).where(F.size("ids") == context + 1)


def examples(windowed: DataFrame) -> DataFrame:
    """(window_id, inputs, targets): targets are the inputs one place on."""
    n = F.size("ids") - 1
    return windowed.select("window_id", F.slice("ids", F.lit(1), n).alias("inputs"), F.slice("ids", F.lit(2), n).alias("targets"))


def next_token_example(stream: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(off, n, ids) -> (window_id, inputs, targets) of the first window only; a stream that can't fill it is an error."""
    window_count(stream.agg(F.sum("n")).first()[0] or 0, context)
    return examples(windows(stream.where(F.col("off") <= context), context, wanted=stream.sparkSession.range(1).withColumnRenamed("id", "window_id")))


def window_count(stored_total: int, context: int = CONTEXT) -> int:
    if stored_total < context + 1:
        raise ValueError("the stream is shorter than one window")
    return (stored_total - 1) // context


def batch_range(cursor: int, size: int, total: int) -> range:
    """Window ids of the next batch; a batch that the stream can't fill is an error, for windows are never used twice."""
    if cursor < 0 or size <= 0 or cursor + size > total:
        raise IndexError(f"windows {cursor} to {cursor + size} of {total}")
    return range(cursor, cursor + size)


def indexed_batch(stream: DataFrame, requests: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(place, window_id) requests -> (place, window_id, inputs, targets), repeated requests included."""
    return requests.join(examples(windows(stream, context, wanted=requests)), "window_id").select("place", "window_id", "inputs", "targets")


def source_counts(stream: DataFrame, windows_total: int, context: int = CONTEXT) -> DataFrame:
    """(off, n, source) -> (window_id, source, n_targets): target ids of each source in each window.

    Target places of window w are w * context + 1 to (w + 1) * context, so the first stored id belongs to none.
    """
    spans = stream.select("source", F.greatest(F.col("off"), F.lit(1)).alias("a"), (F.col("off") + F.col("n")).alias("b")).where("a < b")
    each = spans.select("*", F.explode(F.sequence(F.expr(f"(a - 1) div {context}"), F.expr(f"(b - 2) div {context}"))).alias("window_id")).where(F.col("window_id") < windows_total)
    n = F.least(F.col("b"), F.col("window_id") * context + context + 1) - F.greatest(F.col("a"), F.col("window_id") * context + 1)
    return each.groupBy("window_id", "source").agg(F.sum(n).alias("n_targets"))


def window_digests(windowed: DataFrame) -> DataFrame:
    """(window_id, digest): SHA-256 over the id as uint32 and the low 16 bits of each stored id, little-endian."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [sha256(np.uint32(w).tobytes() + np.asarray(ids, np.int64).astype(np.uint16).tobytes()).hexdigest() for w, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["window_id", "digest"])

    return windowed.select("window_id", "ids").mapInArrow(run, "window_id bigint, digest string")


def set_digest(digests: DataFrame, group: int = 4096) -> str:
    """(window_id, digest) -> one digest of the set in the order of ids: SHA-256 over those of runs of ``group`` ids, which are over the digests' bytes.

    Windows meet only within a run; the runs' digests, one for ``group`` windows, are put together by the driver.
    """
    runs = digests.groupBy(F.expr(f"window_id div {group}").alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window_id", "digest"))), lambda x: x.digest), "").alias("all"))
    own = runs.select("run", F.sha2(F.unhex("all"), 256).alias("digest")).toArrow().sort_by("run")["digest"].to_pylist()
    return sha256(b"".join(map(bytes.fromhex, own))).hexdigest()


@dataclass(frozen=True)
class Cursor:
    """Where a run stands in a schedule: the next position, and the arm and digest of the schedule it was drawn from."""

    position: int
    arm: str
    digest: str

    @classmethod
    def after(cls, step: int, batch: int, arm: str, digest: str) -> Cursor:
        """Of a log that has only the step."""
        return cls(step * batch, arm, digest)

    def take(self, schedule: DataFrame, size: int, total: int, digest: str) -> tuple[DataFrame, Cursor]:
        """(position, window_id) of the next batch, and the cursor behind it. Another schedule than the cursor's, or one that ends, is an error."""
        if digest != self.digest:
            raise RuntimeError("the cursor is of another schedule")
        r = batch_range(self.position, size, total)
        rows = schedule.where((F.col("schedule") == self.arm) & F.col("position").between(r.start, r.stop - 1)).select("position", "window_id")
        return rows, Cursor(r.stop, self.arm, digest)


def capacities(requests: DataFrame, permitted: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(experiment, artifact, tokens) -> with ``windows``, null where ``permitted`` (the same columns, a parameter table) has no such row or the tokens fill no whole windows."""
    allowed = permitted.select("experiment", "artifact", "tokens").distinct().withColumn("_ok", F.lit(True))
    out = requests.join(F.broadcast(allowed), ["experiment", "artifact", "tokens"], "left")
    return out.withColumn("windows", F.when(F.col("_ok") & (F.col("tokens") % context == 0), F.expr(f"tokens div {context}"))).drop("_ok")


def rolling_windows(lengths: DataFrame, most: int = CONTEXT) -> DataFrame:
    """(id, n) -> (id, part, first, scored): disjoint windows in which every token is scored exactly once."""
    return lengths.where("n > 0").select("id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / most).cast("int"))).alias("part")).select("id", "part", (F.col("part") * most).alias("first"), F.least(F.lit(most), F.col("n") - F.col("part") * most).alias("scored"))
