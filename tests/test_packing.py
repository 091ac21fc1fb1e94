import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import packing as P
from quern.operators import schedule as S
from quern.operators.prefix import place_in_group, previous, running_total
from quern.sources import artifacts as A

SCHEMA = "seq bigint, ids array<int>, source string, off int, n int"


def stream_of(spark, docs, eod=99, **options):
    rows = [(k, ids, src, None, None) for k, (ids, src) in enumerate(docs)]
    return P.offsets(spark.createDataFrame(rows, SCHEMA).select("seq", "ids", "source").repartition(3), eod, **options)


def flat(docs, eod=99):
    return [x for ids, _ in docs if ids is not None for x in [*ids, eod]]


def random_docs(seed, n=60):
    r = random.Random(seed)
    return [(None if r.random() < 0.05 else [r.randrange(90) for _ in range(r.choice([0, 1, 3, 8, 40]))], r.choice(["fineweb", "fineweb_edu", None])) for _ in range(n)]


def test_end_after_every_document(spark):
    rows = stream_of(spark, [([10, 11], "a"), ([20, 21], "a")]).orderBy("off").collect()
    assert [x for r in rows for x in r.ids] == [10, 11, 99, 20, 21, 99] and [r.off for r in rows] == [0, 3]


def test_next_token_example_is_the_first_window(spark):
    docs = [([1, 2, 3], "a"), ([4, 5, 6, 7], "a"), ([8], "a")]
    ids = flat(docs)
    rows = P.next_token_example(stream_of(spark, docs), 6).collect()
    assert [(r.inputs, r.targets) for r in rows] == [(ids[:6], ids[1:7])]
    assert [(r.inputs, r.targets) for r in P.next_token_example(stream_of(spark, docs), len(ids) - 1).collect()] == [(ids[:-1], ids[1:])]
    with pytest.raises(ValueError):
        P.next_token_example(stream_of(spark, docs), len(ids))


@pytest.mark.parametrize("context", [1, 4, 16])
def test_windows_are_slices_of_the_stream(spark, context):
    docs = random_docs(context)
    ids = flat(docs)
    got = {r.window_id: r for r in P.examples(P.windows(stream_of(spark, docs), context)).collect()}
    assert len(got) == P.window_count(len(ids), context)
    for w, r in got.items():
        assert r.inputs == ids[w * context : w * context + context] and r.targets == ids[w * context + 1 : w * context + context + 1]


def test_batches_keep_order_and_repeats(spark):
    docs = random_docs(7)
    ids, s = flat(docs), stream_of(spark, docs)
    wanted = [5, 2, 5, 0]
    rows = P.indexed_batch(s, spark.createDataFrame(list(enumerate(wanted)), "place int, window_id bigint"), 8).orderBy("place").collect()
    assert [r.window_id for r in rows] == wanted and all(r.inputs == ids[r.window_id * 8 : r.window_id * 8 + 8] for r in rows)
    with pytest.raises(ValueError):
        P.window_count(8, 8)


def test_cut_within_a_document(spark):
    docs = random_docs(8)
    rows = stream_of(spark, docs, stored_total=50).orderBy("off").collect()
    assert [x for r in rows for x in r.ids] == flat(docs)[:50] and sum(r.n for r in rows) == 50


def test_sources_of_targets(spark):
    docs = [([11, 12], "fineweb"), ([21, 22], "fineweb_edu"), ([13, 14], "fineweb")]
    labels = [s for ids, s in docs for _ in range(len(ids) + 1)]
    got = {(r.window_id, r.source): r.n_targets for r in P.source_counts(stream_of(spark, docs), 4, 2).collect()}
    want = {}
    for place in range(1, 9):
        key = ((place - 1) // 2, labels[place])
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_digest_bytes(spark):
    docs = random_docs(3)
    ids = flat(docs)
    for r in P.window_digests(P.windows(stream_of(spark, docs), 8)).collect():
        assert r.digest == sha256(np.uint32(r.window_id).tobytes() + np.array(ids[r.window_id * 8 : r.window_id * 8 + 9], np.uint16).tobytes()).hexdigest()


def test_schedule_golden(spark):
    """48 targets in 12 windows of 4; 8 of the first phase; LOW 8 and 9, HIGH 10 and 11."""
    counts = spark.createDataFrame([(k, 0 if k < 10 else 4) for k in range(12)], "window_id bigint, n int")
    phases = S.ranked(counts, 8, 2)
    by = {}
    for r in S.schedules(phases, 8, 2).orderBy("position").collect():
        by.setdefault(r.schedule, []).append(r.window_id)
    assert by == {"static": list(range(12)), "cooldown_edu": list(range(12)), "precooldown_edu": [*range(8), 10, 11, 8, 9]}
    assert all(r.positions_ok and r.permutation_ok for r in S.integrity(S.schedules(phases, 8, 2), 12).collect())
    assert not S.integrity(S.schedules(phases, 8, 2).where("position <> 3"), 12).first().positions_ok
    assert S.contrast(phases, 4) == 1.0
    with pytest.raises(RuntimeError):
        S.contrast(S.ranked(counts.withColumn("n", F.lit(0)), 8, 2), 4, 0.15)


def test_rolling_windows_score_each_token_once(spark):
    rows = P.rolling_windows(spark.createDataFrame([(1, 0), (2, 1), (3, 512), (4, 513), (5, 2000)], "id int, n int")).groupBy("id").agg(F.sum("scored").alias("n"), F.max("scored").alias("most")).collect()
    assert {r.id: r.n for r in rows} == {2: 1, 3: 512, 4: 513, 5: 2000} and max(r.most for r in rows) == 512


def test_running_total(spark):
    r = random.Random(2)
    rows = [(k % 3, r.randrange(50), k, r.randrange(9)) for k in range(200)]
    got = {x.k: x.before for x in running_total(spark.createDataFrame(rows, "g int, o int, k int, v int"), "v", ["o", "k"], "before", by=["g"]).collect()}
    for g in range(3):
        total = 0
        for x in sorted((x for x in rows if x[0] == g), key=lambda x: x[1:3]):
            assert got[x[2]] == total
            total += x[3]


@pytest.mark.parametrize("chunk", [3, 7, 1 << 20])
def test_stream_files(spark, tmp_path, chunk):
    docs = [([8191, 0, 3], "a"), ([512, 7], "a"), ([], "a"), ([11, 0, 13], "a")]
    s, ids = stream_of(spark, docs, eod=0), flat(docs, 0)
    out = str(tmp_path / "stream")
    files = A.write_stream(s, out, len(ids), chunk=chunk).orderBy("part").collect()
    assert b"".join(open(r.path, "rb").read() for r in files) == np.array(ids, "<u2").tobytes()
    assert [r.stored_so_far for r in files] == [min(len(ids), (k + 1) * chunk) for k in range(len(files))]
    back = A.read_stream(spark, out, chunk).orderBy("off").collect()
    assert [x for r in back for x in r.ids] == ids
    assert sum(r.n for r in A.read_stream(spark, out, chunk, visible=5).collect()) == 5
    for bad in ({"stored_total": len(ids) + 1}, {"stored_total": len(ids) - 1}, {"stored_total": len(ids), "vocabulary": 8191}, {"stored_total": 0}, {"stored_total": len(ids), "chunk": 0}):
        with pytest.raises((RuntimeError, ValueError)):
            A.write_stream(s, str(tmp_path / "bad"), **bad)


def test_cursor_never_wraps():
    assert list(P.batch_range(2, 3, 5)) == [2, 3, 4]
    for bad in ((3, 3, 5), (-1, 1, 5), (0, 0, 5)):
        with pytest.raises(IndexError):
            P.batch_range(*bad)


def test_running_total_with_null_groups_and_many_batches(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), k, r.randrange(5)) for k in range(3000)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {x.o: x.before for x in running_total(spark.createDataFrame(rows, "g string, o int, v int"), "v", ["o"], "before", by=["g"]).collect()}
        plain = {x.o: x.before for x in running_total(spark.createDataFrame(rows, "g string, o int, v int"), "v", ["o"], "before").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    sums, whole = {}, 0
    for g, o, v in rows:
        assert got[o] == sums.get(g, 0) and plain[o] == whole
        sums[g], whole = sums.get(g, 0) + v, whole + v
    assert running_total(spark.createDataFrame([], "g string, o int, v int"), "v", ["o"], "before", by=["g"]).isEmpty()


def test_previous_and_places(spark):
    """The row before in a group, over parts, batches and null groups."""
    r = random.Random(9)
    rows = [(r.choice(["a", "b", None]), k, r.choice([None, 1, 2, 3])) for k in range(2000)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        df = spark.createDataFrame(rows, "g string, o int, v int")
        got = {x.o: x.was for x in previous(df.repartition(5), "v", ["o"], "was", ["g"]).collect()}
        places = {x.o: x.at for x in place_in_group(df, ["g"], ["o"], "at").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    last, n = {}, {}
    for g, o, v in rows:
        assert got[o] == last.get(g) and places[o] == n.get(g, 0)
        last[g], n[g] = v, n.get(g, 0) + 1
    empty = spark.createDataFrame([], "g string, o int, v int")
    assert previous(empty, "v", ["o"], "was", ["g"]).isEmpty() and place_in_group(empty, ["g"], ["o"], "at").isEmpty()


def test_cursor_of_a_schedule(spark):
    own = spark.createDataFrame([(s, k, (k * 3) % 10) for s in ("x", "y") for k in range(10)], "schedule string, position int, window_id int")
    rows, cursor = P.Cursor.after(2, 2, "x", "d").take(own, 4, 10, "d")
    assert sorted((r.position, r.window_id) for r in rows.collect()) == [(4, 2), (5, 5), (6, 8), (7, 1)] and cursor == P.Cursor(8, "x", "d")
    with pytest.raises(RuntimeError):
        cursor.take(own, 2, 10, "other")
    with pytest.raises(IndexError):
        cursor.take(own, 3, 10, "d")


def test_capacities(spark):
    schema = "experiment string, artifact string, tokens bigint"
    permitted = spark.createDataFrame([("e", "a", 1024), ("e", "b", 1000), ("e", "a", 1024)], schema)
    asked = spark.createDataFrame([("e", "a", 1024), ("e", "a", 512), ("e", "b", 1000), ("f", "a", 1024), (None, "a", None)], schema)
    assert sorted(((r.experiment, r.artifact, r.tokens, r.windows) for r in P.capacities(asked, permitted).collect()), key=str) == sorted([("e", "a", 1024, 2), ("e", "a", 512, None), ("e", "b", 1000, None), ("f", "a", 1024, None), (None, "a", None, None)], key=str)


def test_set_digest_depends_on_order_and_members_alone(spark):
    rows = [(k, sha256(str(k).encode()).hexdigest()) for k in range(50)]
    df = spark.createDataFrame(rows, "window_id bigint, digest string")
    one = P.set_digest(df.repartition(7), 8)
    runs = [sha256(b"".join(bytes.fromhex(d) for _, d in rows[k : k + 8])).digest() for k in range(0, 50, 8)]
    assert one == P.set_digest(df, 8) == sha256(b"".join(runs)).hexdigest() != P.set_digest(df.where("window_id <> 3"), 8)
