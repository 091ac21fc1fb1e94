"""Running totals, places and neighbours over an order without gathering it, or a group of it, in one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.runtime import materialize


def _within(value: str, by: list[str]):
    """Appends to sorted batches the sum of ``value`` over the rows before in the same group and partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, group = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            changed = np.zeros(len(v), bool)
            for c in by:
                codes = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                changed[1:] |= codes[1:] != codes[:-1]
            first = tuple(b.column(c)[0].as_py() for c in by)
            changed[0] = first != group
            before = np.cumsum(v) - v
            starts = np.flatnonzero(np.append(True, changed[1:]))
            sizes = np.diff(np.append(starts, len(v)))
            own = before - np.repeat(before[starts], sizes)
            if not changed[0]:
                own[: sizes[0]] += carried
            carried, group = int(own[-1] + v[-1]), tuple(b.column(c)[-1].as_py() for c in by)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], names=[*b.schema.names, "_within"])

    return run


def running_total(df: DataFrame, value: str, order: list[str], out: str, by: list[str] = [], label: str = "prefix") -> DataFrame:  # noqa: B006
    """``df`` with ``out``: the sum of ``value``, which is never null, over the rows before, in each group of ``by``.

    A parallel prefix sum with one shuffle: rows are range-partitioned and sorted by group and order, each part
    sums as it passes and is written once, and the totals of the parts before it, a row for each part and group,
    are added by broadcast: ``by`` must have few groups. ``by + order`` must be unique.
    """
    keys = [*by, *order]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)  # adaptive execution joins neighbouring small parts
    summed = spread.mapInArrow(_within(value, by), T.StructType([*df.schema, T.StructField("_within", T.LongType())]))
    parts = materialize(summed.withColumn("_part", F.spark_partition_id()), label)
    totals = parts.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))  # a row for each part
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return parts.join(F.broadcast(bases), same).select(*df.columns, (F.col("_base") + F.col("_within")).cast("bigint").alias(out))


def _before(value: str, by: list[str]):
    """Appends to sorted batches the value of the row before in the same group and partition, and whether there is one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, None
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(value)
            same = np.ones(len(v), bool)
            for c in by:
                codes = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                same[1:] &= codes[1:] == codes[:-1]
            same[0] = tuple(b.column(c)[0].as_py() for c in by) == group
            shifted = pa.concat_arrays([pa.array([last], v.type), v.slice(0, len(v) - 1)])
            yield pa.RecordBatch.from_arrays([*b.columns, shifted, pa.array(same)], names=[*b.schema.names, "_was", "_same"])
            last, group = v[-1].as_py(), tuple(b.column(c)[-1].as_py() for c in by)

    return run


def previous(df: DataFrame, value: str, order: list[str], out: str, by: list[str], label: str = "previous") -> DataFrame:
    """``df`` with ``out``: ``value`` of the row before in the order of its group, null for the first.

    One shuffle, by ranges of the whole order, so that a group of any size is spread; between parts only a row for each
    part and group is passed on, by broadcast: ``by`` must have few groups. ``by + order`` must be unique.
    """
    keys = [*by, *order]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    seen = spread.mapInArrow(_before(value, by), T.StructType([*df.schema, T.StructField("_was", df.schema[value].dataType), T.StructField("_same", T.BooleanType())]))
    parts = materialize(seen.withColumn("_part", F.spark_partition_id()), label)
    ends = parts.groupBy(*by, "_part").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_end"))
    passed = ends.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_p"), F.lag(F.col("_end")[value]).over(Window.partitionBy(*by).orderBy("_part")).alias("_passed"))  # a row for each part
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return parts.join(F.broadcast(passed), same).select(*df.columns, F.when(F.col("_same"), F.col("_was")).otherwise(F.col("_passed")).alias(out))


def place_in_group(df: DataFrame, by: list[str], order: list[str], out: str, label: str = "places") -> DataFrame:
    """``df`` with ``out``: how many rows of its group stand before it. Groups may be many, and of any size; ``by + order`` must be unique."""
    numbered = running_total(df.withColumn("_one", F.lit(1).cast("bigint")), "_one", [*by, *order], "_at", label=label)
    starts = numbered.groupBy(*by).agg(F.min("_at").alias("_start")).toDF(*(f"_{c}" for c in by), "_start")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return numbered.join(starts, same).select(*df.columns, (F.col("_at") - F.col("_start")).alias(out))
