import random

import pytest
from pyspark.sql import functions as F

from quern.llm import seen

SCHEMA = "row_id bigint, key binary, seen boolean, kind int"


def brute(rows, known=()):
    first = {}
    for r, k, *_ in rows:
        if k is not None and len(k) == 32 and r is not None:
            first[k] = min(first.get(k, r), r)
    return {r: k in known or first[k] < r for r, k, *_ in rows if k is not None and len(k) == 32 and r is not None}


def keys(seed, n=3000):
    r = random.Random(seed)
    pool = [r.randbytes(32) for _ in range(700)]
    pool += [pool[0][:31] + bytes([k]) for k in range(50)]  # resembling each other
    hot = pool[0]
    rows = [(k * 2 + 5, r.choice([hot, r.choice(pool), r.randbytes(32), r.choice([None, b"", r.randbytes(31), r.randbytes(33)])]), None, 1) for k in range(n)]
    r.shuffle(rows)
    return rows, pool


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("filter_bytes", [1 << 25, 256])
def test_decisions_are_exact(spark, seed, filter_bytes, monkeypatch):
    """Whatever the filter's size, and with a hot key in a quarter of all rows."""
    if filter_bytes == 256:
        monkeypatch.setattr(seen.sketch, "SEGMENT", 64)
    rows, pool = keys(seed)
    known = pool[100:160]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    before = spark.createDataFrame([(k,) for k in [*known, *known, None, b"short"]], "key binary")
    got = seen.decide(df, before, filter_bytes=filter_bytes).collect()
    assert len(got) == len({x.row_id for x in got}) and {x.row_id: x.seen for x in got} == brute(rows, set(known))
    assert not any(x.seen and not x.filter_seen for x in got), "the filter never calls a seen key new"


def test_many_shards_and_a_key_in_most_rows(spark):
    """More shards than cores, and a key that is three quarters of all rows: sent at most once for each batch."""
    r = random.Random(5)
    hot = r.randbytes(32)
    rows = [(k, hot if r.random() < 0.75 else r.randbytes(32) if r.random() < 0.5 else bytes([r.randrange(40)]) * 32, None, 1) for k in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = seen.decide(df, df.where("row_id % 97 = 0").select("key"), shard_keys=200).collect()
    assert {x.row_id: x.seen for x in got} == brute(rows, {k for i, k, *_ in rows if i % 97 == 0}) and len(got) == len(rows)


def test_most_new_keys_are_decided_by_the_filter(spark):
    r = random.Random(9)
    rows = [(k, r.randbytes(32), None, None) for k in range(4000)]
    got = seen.decide(spark.createDataFrame(rows, SCHEMA)).agg(F.count_if("filter_seen").alias("f"), F.count_if("seen").alias("s")).first()
    assert got.s == 0 and got.f < 400


def test_ties_nothing_and_null_rows(spark):
    assert seen.decide(spark.createDataFrame([], SCHEMA)).collect() == []
    none = [(None, bytes(32), None, None), (1, None, None, None), (2, bytes(31), None, None)]
    assert seen.decide(spark.createDataFrame(none, SCHEMA)).collect() == []
    assert [(x.row_id, x.seen) for x in seen.decide(spark.createDataFrame([(4, bytes(32), None, None)], SCHEMA), spark.createDataFrame([], "key binary")).collect()] == [(4, False)]


def test_document_keys(spark):
    d = "0123456789abcdef" * 4
    forms = [d, d.upper(), f"sha256:{d}", f"  SHA256:{d.upper()}\t", f" {d}"]
    bad = [None, "", d[:-1], d + "0", f"sha1:{d}", "g" * 64, f"x {d}"]
    df = spark.createDataFrame([(x,) for x in forms + bad], "x string").select(seen.document_key(F.col("x")).alias("k"))
    assert [r.k and bytes(r.k) for r in df.collect()] == [bytes.fromhex(d)] * len(forms) + [None] * len(bad)
