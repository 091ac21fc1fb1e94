import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import packing

ITEMS, LIMITS = "seq bigint, ids array<int>, n_ids int, unused int, window_id int", "limit_name string, max_tokens int, overlap_tokens int, seq int"


def rows_of(seed, n=400):
    r = random.Random(seed)
    rows = [(k, r.choice([None, [], [9000] * 3] + [[1] * r.randint(1, 90)] * 12 + [[2] * r.randint(90, 400)]), None, 0, 0) for k in range(n)]
    return rows + r.sample(rows, 40) + [(None, [1], 1, 0, 0)]


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("options", [{}, {"shard_items": 50}, {"max_places": 3}, {"cost_factor": 0.5}])
def test_every_token_once_within_all_capacities(spark, score, options):
    rows = rows_of(1)
    limits = [("a", 64, 0, 1), ("b", 128, 16, 1), ("again", 64, 8, 1), ("none", None, 0, 1), ("zero", 0, 0, 1)]
    if "cost_factor" in options:
        limits = [("b", 128, 16, 1)]
        rows = [(s, i and i[:90], *x) for s, i, *x in rows]
    got = packing.pack(spark.createDataFrame(rows, ITEMS).repartition(3), spark.createDataFrame(limits, LIMITS), score=score, **options).collect()
    want = {s: len(i) for s, i, *_ in rows if i and s is not None}
    for m in {x.max_tokens for x in got}:
        parts, windows = defaultdict(list), defaultdict(list)
        for x in got:
            if x.max_tokens == m:
                parts[x.seq].append(x)
                windows[x.window_id].append(x)
        assert {s: sum(x.n_tokens for x in p) for s, p in parts.items()} == want
        for s, p in parts.items():
            p.sort(key=lambda x: x.part)
            assert [x.start for x in p] == [k * m for k in range(len(p))] and (len(p) == 1 or want[s] > m)
        for w in windows.values():
            used = sum(x.n_tokens for x in w)
            assert used <= m and all(x.unused == m - used for x in w) and len(w) <= options.get("max_places", 64)
            assert sum(x.n_tokens**2 for x in w) <= options.get("cost_factor", 1.0) * m * m + 1e-6
    assert {x.max_tokens for x in got} == {x[1] for x in limits if x[1]}


def test_little_room_is_wasted(spark):
    rows = rows_of(2, 4000)
    r = packing.room(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([("w", 128, 0, 1)], LIMITS)).first()
    assert r.unused_share < 0.02 and r.windows <= -(-r.tokens // 128) * 1.02


def test_same_on_every_layout(spark):
    rows, limits = rows_of(3), spark.createDataFrame([("w", 100, 0, 1)], LIMITS)
    one = Counter(map(tuple, packing.pack(spark.createDataFrame(rows, ITEMS).repartition(1), limits, shard_items=100).collect()))
    assert one == Counter(map(tuple, packing.pack(spark.createDataFrame(rows[::-1], ITEMS).repartition(7), limits, shard_items=100).collect()))


def test_nothing(spark):
    items, limits = spark.createDataFrame([], ITEMS), spark.createDataFrame([], LIMITS)
    assert packing.pack(items, spark.createDataFrame([("w", 10, 0, 1)], LIMITS)).collect() == packing.pack(spark.createDataFrame(rows_of(4), ITEMS), limits).collect() == []
    assert packing.best_fit(np.zeros(0, np.int64), 5, 5, 25).tolist() == []


def test_best_fit_prefers_the_tightest_window():
    assert packing.best_fit(np.array([7, 6, 4, 3]), 10, 9, 10**6).tolist() == [0, 1, 1, 0]


def test_an_item_beyond_the_cost_stands_alone():
    assert packing.best_fit(np.array([100, 60, 40]), 100, 64, 5000).tolist() == [0, 1, 2]
    assert packing.best_fit(np.array([100, 60, 40, 30]), 100, 64, 6000).tolist() == [0, 1, 1, 2]


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_the_cost_capacity_binds(spark, score):
    """Windows of several items stay below it, items above it are whole and alone, and some pair is kept apart by it alone."""
    rows = [(k, [1] * n, None, 0, 0) for k, n in enumerate([96, 4] * 30 + [50, 50] * 30 + [70, 30] * 20)]
    got = packing.pack(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([("w", 100, 0, 1)], LIMITS), cost_factor=0.55, score=score).collect()
    windows = defaultdict(list)
    for x in got:
        windows[x.window_id].append(x.n_tokens)
    assert sorted(n for w in windows.values() for n in w) == sorted(len(i) for _, i, *_ in rows)
    assert all(len(w) == 1 or sum(n * n for n in w) <= 5500 for w in windows.values())
    assert all(len(w) == 1 for w in windows.values() if 96 in w) and not any(sorted(w) == [30, 70] for w in windows.values())
