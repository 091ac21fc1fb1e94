"""Problem 5: filling windows of fixed capacity.

Vector best fit, decreasing. An item takes tokens, one place, and attention cost (its tokens squared); a
window has a capacity of each. Items larger than a window are first cut into full windows and a rest. Items
go to shards by hash, enough items for each that only its last windows stay open; a shard's items are
placed largest first, each into the open window that holds it under every constraint and scores best: by
the smallest weighted norm of what would be left, or the largest weighted dot product. The capacity of attention cost
is below what one full-sized item costs: such an item isn't cut, but has a window to itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a shard, about.
SHARD_ITEMS = 4000
#: Tasks that fill shards, at most.
MOST_TASKS = 20_000
#: Weights of tokens, places and attention cost in the score.
WEIGHTS = (1.0, 0.05, 0.05)
#: Attention cost a window may have, as a share of that of one item of its size; an item that alone costs more stands alone.
COST_SHARE = 0.95


def best_fit(sizes: np.ndarray, capacity: int, places: int, cost: int, score: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The window number of each size, largest sizes first; each size is at most ``capacity``.

    A size whose square is above ``cost`` opens a window that holds nothing else.
    """
    full = np.array([capacity, places, cost], np.float64)
    w = np.array(weights)
    left = np.zeros((len(sizes), 3))  # residual capacities of the open windows, as shares
    numbers = np.zeros(len(sizes), np.int64)  # of the open windows
    n_open = made = 0
    out = np.empty(len(sizes), np.int64)
    least = float(sizes.min()) / capacity if len(sizes) else 0
    least_cost = float(sizes.min()) ** 2 / cost if len(sizes) else 0
    for k, size in enumerate(sizes.tolist()):
        need = np.array([size, 1, size * size]) / full
        rest = left[:n_open] - need
        fits = np.flatnonzero((rest >= -1e-12).all(axis=1))
        if len(fits):
            value = -((rest[fits] ** 2) @ w) if score == "norm" else left[fits] @ (w * need)
            at = int(fits[np.argmax(value)])  # the earliest of equals
            left[at] = rest[at]
        else:
            at, n_open = n_open, n_open + 1
            left[at], numbers[at], made = 1 - need, made, made + 1  # below 0 for an item that stands alone
        out[k] = numbers[at]
        if left[at, 0] + 1e-12 < least or left[at, 1] * places < 0.5 or left[at, 2] + 1e-12 < least_cost:  # closed: nothing fits any more
            n_open -= 1
            left[at], numbers[at] = left[n_open], numbers[n_open]
    return out


def pack(items: DataFrame, limits: DataFrame, *, id_col: str = "seq", ids_col: str = "ids", max_places: int = 64, cost_factor: float = COST_SHARE, shard_items: int = SHARD_ITEMS, score: str = "norm") -> DataFrame:
    """(max_tokens, window_id, seq, part, start, n_tokens, unused): where each item or part of one stands.

    ``limits`` gives the distinct capacities, a few; a null or non-positive one is left out. ``start`` is the
    first token of the part within its item, ``unused`` the room left in its window. An item delivered twice
    is placed once (the longest delivery, should they differ); null and empty items need no room and have no
    row, nor do rows with a null id. Ids outside the vocabulary take room like any other. ``max_places`` bounds
    the items of a window, ``cost_factor`` its attention cost in shares of max_tokens squared, unless one item alone has
    more. No item or no
    limit gives no row. The result depends neither on the order nor on the partitions of the input.
    """
    sizes = items.select(F.col(id_col).cast("bigint").alias("seq"), F.size(ids_col).alias("n")).where("seq is not null and n > 0").groupBy("seq").agg(F.max("n").alias("n"))
    capacities = limits.select(F.col("max_tokens").cast("int").alias("max_tokens")).where("max_tokens > 0").distinct()
    total = sizes.count()
    shards = max(1, total // shard_items)
    each = [r.max_tokens for r in capacities.orderBy("max_tokens").collect()]  # a parameter table
    placed = sizes.withColumn("max_tokens", F.explode(F.array(*[F.lit(x) for x in each]).cast("array<int>")))
    salted = placed.withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(shards)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, shard = int(pdf.max_tokens.iloc[0]), int(pdf.shard.iloc[0])
        pdf = pdf.sort_values("seq", kind="stable")
        seq, n = pdf.seq.to_numpy(), pdf.n.to_numpy().astype(np.int64)
        parts = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start = part * capacity
        size = np.minimum(capacity, n[row] - start)
        order = np.lexsort((part, seq[row], -size))
        row, part, start, size = row[order], part[order], start[order], size[order]
        window = best_fit(size, capacity, max_places, max(1, int(cost_factor * capacity * capacity)), score)
        used = np.bincount(window, weights=size)
        return pd.DataFrame({"max_tokens": np.int32(capacity), "window_id": (np.int64(shard) << 32) + window, "seq": seq[row], "part": part.astype(np.int32), "start": start.astype(np.int32), "n_tokens": size.astype(np.int32), "unused": (capacity - used[window]).astype(np.int32)})

    # filling is work, not bytes: as many tasks as there are groups, and no joining of small ones
    tasks = max(1, min(shards * len(each), MOST_TASKS))
    return salted.repartition(tasks, "max_tokens", "shard").groupBy("max_tokens", "shard").applyInPandas(fill, "max_tokens int, window_id bigint, seq bigint, part int, start int, n_tokens int, unused int")


def room(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Of each capacity: items, parts, windows, tokens, and the unused room in tokens and as a share."""
    placed = pack(items, limits)
    windows = placed.groupBy("max_tokens", "window_id").agg(F.max("unused").alias("unused"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"), F.count_if(F.col("part") == 0).alias("items"))
    return windows.groupBy("max_tokens").agg(F.sum("items").alias("items"), F.sum("parts").alias("parts"), F.count(F.lit(1)).alias("windows"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused")).withColumn("unused_share", F.col("unused") / (F.col("windows") * F.col("max_tokens")))


def totals(items: DataFrame, limits: DataFrame, max_places: int = 64, cost_factor: float = COST_SHARE) -> DataFrame:
    """Of each capacity: items, parts and tokens placed, items cut, and windows beyond each of the three capacities, or whose unused room is misstated."""
    placed = pack(items, limits, max_places=max_places, cost_factor=cost_factor)
    n = F.col("n_tokens").cast("bigint")
    windows = placed.groupBy("max_tokens", "window_id").agg(F.sum(n).alias("tokens"), F.count(F.lit(1)).alias("parts"), F.sum(n * n).alias("cost"), F.count_if(F.col("part") == 0).alias("items"), F.count_if(F.col("part") == 1).alias("cut"), F.min(F.col("unused")).alias("least"), F.max(F.col("unused")).alias("most"))
    left = F.col("max_tokens") - F.col("tokens")
    return windows.groupBy("max_tokens").agg(
        F.sum("items").alias("items"),
        F.sum("parts").alias("parts"),
        F.sum("tokens").alias("tokens"),
        F.sum("cut").alias("items_cut"),
        F.count_if(left < 0).alias("over_tokens"),
        F.count_if(F.col("parts") > max_places).alias("over_places"),
        F.count_if((F.col("parts") > 1) & (F.col("cost") > F.lit(cost_factor) * F.col("max_tokens") * F.col("max_tokens"))).alias("over_cost"),
        F.count_if((F.col("least") != left) | (F.col("most") != left)).alias("misstated"),
    )
