"""Bounded summaries that Python operators probe while they scan.

All are fixed-size arrays of small integers cut into segments; partial arrays of the tasks are merged segment by
segment in Spark, and only the merged array, whose size is capped by a parameter, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENT = 1 << 16


def power_of_two(n: int, least: int, most: int) -> int:
    return max(least, min(most, 1 << max(0, int(n) - 1).bit_length()))


def _merge_segments(merge: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(v, kind)
                held[k] = merge(held[k], x) if k in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["segment", "bytes"])

    return run


def build(df: DataFrame, size: int, key_bytes: int, update: Callable[[np.ndarray, pa.RecordBatch], None], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], empty: int = 0, kind: type = np.uint8) -> np.ndarray:
    """Fold the rows of ``df``, of about ``key_bytes`` together, into one array of ``size`` cells.

    ``update`` adds a record batch to a task's array in place, ``merge`` joins two arrays; ``empty`` is the
    value of an untouched cell. Segments nobody touched aren't sent, and no more tasks build arrays than the
    keys themselves have the bytes of, so that merging never moves more than the keys.
    """
    builders = max(1, key_bytes // (size * np.dtype(kind).itemsize))

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = np.full(size, empty, kind), False
        for b in batches:
            if b.num_rows:
                update(own, b)
                seen = True
        if seen:
            for k in range(0, size, SEGMENT):
                part = own[k : k + SEGMENT]
                if (part != empty).any():
                    yield pa.RecordBatch.from_arrays([pa.array([k // SEGMENT], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["segment", "bytes"])

    schema = "segment int, bytes binary"
    parts = df.coalesce(builders).mapInArrow(partial, schema)
    merged = parts.repartition(max(1, min(200, builders, size // SEGMENT)), "segment").mapInArrow(_merge_segments(merge, kind), schema)
    out = np.full(size, empty, kind)
    for row in merged.toLocalIterator():  # together ``size`` cells
        out[row.segment * SEGMENT :][: SEGMENT] = np.frombuffer(row.bytes, kind)
    return out


def slots(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(width - 1)
    return (hashes & low).astype(np.int64), ((hashes >> np.uint64(32)) & low).astype(np.int64)


class CountSketch:
    """Two-row count-min sketch of saturating bytes over 64-bit hashes.

    ``estimate`` never falls below the smaller of the true count and 255, so 0 proves absence. For a
    given sketch it is a pure function of the hash: (estimate, hash) is one total order for everybody.
    """

    def __init__(self, cells: np.ndarray) -> None:
        self.cells, self.width = cells, len(cells) // 2

    @staticmethod
    def width_for(keys: int, max_bytes: int) -> int:
        return power_of_two(2 * keys, SEGMENT, max_bytes // 2)

    @classmethod
    def build(cls, df: DataFrame, keys: int, hashes_of: Callable[[pa.RecordBatch], np.ndarray], max_bytes: int) -> CountSketch:
        width = cls.width_for(keys, max_bytes)

        def update(own: np.ndarray, b: pa.RecordBatch) -> None:
            for row, at in enumerate(slots(hashes_of(b), width)):
                where, n = np.unique(at, return_counts=True)
                where += row * width
                own[where] = np.minimum(own[where].astype(np.int64) + n, 255).astype(np.uint8)

        return cls(build(df, 2 * width, 8 * keys, update, lambda x, y: np.minimum(x.astype(np.uint16) + y, 255).astype(np.uint8)))

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        a, b = slots(hashes, self.width)
        return np.minimum(self.cells[a], self.cells[self.width + b])


class Membership:
    """Bloom filter with two bits a key in a byte array; false positives only."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @classmethod
    def build(cls, df: DataFrame, keys: int, hashes_of: Callable[[pa.RecordBatch], np.ndarray], max_bytes: int) -> Membership:
        size = power_of_two(2 * keys, SEGMENT, max_bytes)

        def update(own: np.ndarray, b: pa.RecordBatch) -> None:
            for at in slots(hashes_of(b), size * 8):
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))

        return cls(build(df, size, 8 * keys, update, np.bitwise_or))

    def might_contain(self, hashes: np.ndarray) -> np.ndarray:
        a, b = slots(hashes, len(self.bits) * 8)
        return ((self.bits[a >> 3] >> (a & 7)) & (self.bits[b >> 3] >> (b & 7)) & 1).astype(bool)
