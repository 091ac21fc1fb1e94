import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import schedules as L
from quern.operators import evaluation as E
from quern.operators import progress as G


# The published rates of a run of 9,156 steps, and what its weight decay keeps.
COSINE = ((0, 0.0), (1, 6e-6), (100, 6e-4), (101, 0.0005999999837534675), (3052, 0.00047037116601798384), (6104, 0.00019771284042821013), (8240, 7.351742948488332e-05), (9156, 6e-5))
MOST_KEPT, KEPT = 8251, {(7325, 8240): 0.973, (8241, 9156): 0.558}


def test_learning_rates(spark):
    rows = spark.range(-1, 9157).select(F.col("id").alias("step"), L.cosine_lr(F.col("id"), 6e-4, 6e-5, 100, 9156).alias("cos"), L.wsd_lr(F.col("id"), 6e-4, 6e-5, 100, 9156, 916).alias("wsd")).collect()
    at = {r.step: r for r in rows}
    for step, want in COSINE:
        assert at[step].cos == pytest.approx(want, abs=1e-15)
    assert at[-1].cos == at[-1].wsd == 0 and at[8240].wsd == 6e-4 and 6e-5 < at[8241].wsd < 6e-4 and at[9156].wsd == 6e-5
    for bad in ((0, 9156, 916), (100, 9156, 0), (100, 1016, 916)):
        with pytest.raises(ValueError):
            L.wsd_lr(F.lit(1), 6e-4, 6e-5, bad[0], bad[1], bad[2])


def test_retention(spark):
    run = spark.range(1, 9157).select(F.col("id").alias("step"), L.wsd_lr(F.col("id"), 6e-4, 6e-5, 100, 9156, 916).alias("lr"))
    rows = {r.step: r.coefficient for r in L.retention(run, 0.1).collect()}
    assert max(rows, key=rows.get) == MOST_KEPT
    for (a, b), want in KEPT.items():
        assert sum(rows[k] for k in range(a, b + 1)) / (b + 1 - a) == pytest.approx(want, abs=0.003)


def test_classification(spark):
    """Each decision on both sides of its threshold, and the guard where one loss grows while both together fall."""
    r = random.Random(3)
    rows = [(g, e, g + x, e + y) for x, y in [(-0.02 - 1e-9, -0.02 - 1e-9), (-0.0199, -0.0199), (0.0099, 0.0099), (0.0101, 0.0101), (0.0201, -0.09), (-0.09, 0.0201), (0.0199, -0.09)] for g, e in [(r.uniform(2, 5), r.uniform(2, 5))]]
    rows += [(r.uniform(2, 4), r.uniform(2, 4), r.uniform(2, 4), r.uniform(2, 4)) for _ in range(200)]
    c = L.classify(*(F.col(k) for k in "abcd"))
    got = spark.createDataFrame(rows, "a double, b double, c double, d double").select("*", c["classification"].alias("x"), c["regressed"].alias("r")).collect()
    win, tie, reject = L.DECISIONS
    for k, x in enumerate(got):
        delta, regressed = (x.c + x.d) / 2 - (x.a + x.b) / 2, x.c - x.a > L.REGRESSION or x.d - x.b > L.REGRESSION
        assert (x.x, x.r) == (win if delta <= L.WIN and not regressed else tie if delta <= L.TIE else reject, regressed)
    assert [x.x for x in got[:7]] == [win, tie, tie, reject, tie, tie, win] and [x.r for x in got[:7]] == [False] * 4 + [True, True, False]


def test_run_arithmetic(spark):
    s = L.run_state(F.lit(5), 32768, 512)
    assert tuple(spark.range(1).select(s["tokens"], s["next_window"]).first()) == (163840, 320)
    plan = L.remaining_updates(F.lit(9000), 9156, F.col("m"))
    got = spark.createDataFrame([(None,), (100,), (156,), (500,)], "m int").select(plan["updates"], plan["incomplete"]).collect()
    assert [tuple(r) for r in got] == [(156, False), (100, True), (156, False), (156, False)]


def test_nearest_rank(spark):
    r = random.Random(1)
    groups = {n: [r.randrange(100) for _ in range(n)] for n in (1, 2, 3, 10, 51)}
    df = spark.createDataFrame([(n, x) for n, v in groups.items() for x in [*v, None]] + [(0, None)], "g int, v int")
    q = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {x.g: x for x in E.nearest_ranks(df, "v", ["g"], q).collect()}
    assert set(got) == set(groups)
    for n, v in groups.items():
        assert {k: got[n][k] for k in q} == {k: sorted(v)[round((n - 1) * x)] for k, x in q.items()}
    with pytest.raises(ValueError):
        E.nearest_ranks(df, "v", ["g"], {"x": 1.5})


SCHEMA = "request_id int, request_type string, task string, doc_id int, n_context int, n_continuation int"


def test_accounting(spark):
    rows = spark.createDataFrame([(1, "loglikelihood", "t", 1, 3, 3), (2, "multiple_choice", "t", None, 1, 4), (3, "loglikelihood", "t", 1, 2, 1), (4, "generate_until", "t", 2, 1, 1), (5, None, "t", 2, 1, 0)], SCHEMA)
    assert tuple(E.account(rows.where("request_id < 3")).first()) == (2, 2, 7, 11)
    assert E.account(rows.where("request_id < 4")).first().examples == 2
    assert {r.request_id: r.reason for r in E.check_requests(rows).collect()} == {4: "not a likelihood request", 5: "not a likelihood request"}
    events = E.event_contexts(rows.where("request_id = 1"), 4).orderBy("event").collect()
    assert [r.context for r in events] == [3, 4, 4]
    assert E.event_contexts(spark.createDataFrame([(1, "x", "t", 1, 0, 2)], SCHEMA)).agg(F.min("context")).first()[0] == 1


def test_length_summary(spark):
    r = random.Random(3)
    v = [r.randint(1, 30) for _ in range(101)]
    rows = spark.createDataFrame([(k, "x", "t", 1, 1, n) for k, n in enumerate(v)], SCHEMA)
    s = E.length_summary(rows, ["task"]).first()
    own = sorted(n + 1 for n in v)
    assert (s.requests, s.tokens, s.least, s.p50, s.p95, s.most) == (101, sum(own), own[0], own[round(50.0)], own[round(100 * 0.95)], own[-1])
    assert E.length_summary(rows.limit(0), ["task"]).isEmpty()


def test_scoring_time(spark):
    rates = {128: 8.0, 256: 4.0, 512: 2.0}
    got = E.scoring_time(spark.createDataFrame([(120,), (250,), (511,)], "context int"), rates).first()
    assert (got.optimistic, got.central, got.pessimistic) == (3 / 8, 1 / 8 + 1 / 4 + 1 / 2, 1.5 * 3 / 2)
    tie = E.scoring_time(spark.createDataFrame([(192,), (384,)], "context int"), rates).first()
    assert tie.central == 1 / 8 + 1 / 4
    none = E.scoring_time(spark.createDataFrame([], "context int"), rates).first()
    assert (none.optimistic, none.central, none.pessimistic) == (0, 0, 0)
    with pytest.raises(ValueError):
        E.scoring_time(spark.createDataFrame([], "context int"), {})


def test_rollups(spark):
    events = spark.createDataFrame([(1, -0.5, True), (1, -1.0, True), (2, -1.0, False), (2, -1.0, True)], "request_id int, logprob double, greedy boolean")
    assert sorted(map(tuple, E.request_rollup(events).collect())) == [(1, -1.5, True, 2), (2, -2.0, False, 2)]
    loss = E.weighted_loss(spark.createDataFrame([("a", 1.0, 1), ("a", 4.0, 3)], "k string, loss double, tokens int"), ["k"]).first()
    assert loss.loss == 3.25 and loss.perplexity == pytest.approx(math.exp(3.25))
    choices = spark.createDataFrame([("t", 1, 0, -1.0, 1, True), ("t", 1, 1, -1.0, 4, False), ("t", 2, 0, -2.0, 1, True), ("t", 2, 1, -1.0, 1, False)], "task string, doc_id int, choice int, logprob double, n_bytes int, is_label boolean")
    got = E.accuracy(choices).first()
    assert (got.docs, got.acc, got.acc_norm) == (2, 0.5, 0.0)


def test_curves(spark):
    steps = [(k, k * 64, k * 32768, 1.0 * k) for k in range(1, 2501)]
    rows = spark.createDataFrame(steps, "step int, next_window int, tokens int, loss double")
    assert [(r.start_step, r.end_step, r.mean_loss) for r in E.step_bins(rows).orderBy("bin").collect()] == [(1, 1000, 500.5), (1001, 2000, 1500.5), (2001, 2500, 2250.5)]
    assert E.discontinuities(rows, 64, 32768).isEmpty()
    broken = rows.where("step <> 7").unionByName(rows.where("step = 9")).withColumn("tokens", F.when(F.col("step") == 3, 0).otherwise(F.col("tokens")))
    assert {r.step for r in E.discontinuities(broken, 64, 32768).collect()} == {3, 8, 9}
    a = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 1.0)], "step int, loss double")
    curve = E.joined_curves(a, a)
    assert E.select_checkpoint(curve, 1, 0.003).first().step == 3 and E.select_checkpoint(curve, 9, 0.1).isEmpty()
    with pytest.raises(RuntimeError):
        E.joined_curves(a, a.where("step < 3"))
    assert [r.milestone for r in E.next_milestone(spark.createDataFrame([(0,), (5,), (9,)], "step int"), [0, 5, 9]).orderBy("step").collect()] == [5, 9, None]
    trials = spark.createDataFrame([(8, 5.0, "ok"), (16, 9.0, "oom"), (32, 7.0, "ok")], "microbatch int, tokens_per_second double, status string")
    assert tuple(E.best_batch(trials).first()) == (32, 7.0) and E.best_batch(trials.where("status = 'oom'")).isEmpty()


def test_telemetry(spark):
    rows = spark.createDataFrame([("b", 1, 0, 0, 0.0), ("b", 2, 13, 2, 4.0), ("b", 3, 13, 2, 5.0), ("b", 4, 14, 2, 5.0)], "build string, at int, stored int, documents int, seconds double")
    got = G.telemetry(rows.where("at < 4"), 13, ["build"], ["at"]).orderBy("at").collect()
    assert [r.at for r in got] == [1, 2] and got[0].remaining_seconds is None and got[0].ids_per_second == 0
    assert (got[1].prediction_tokens, got[1].percent, got[1].ids_per_second, got[1].remaining_seconds) == (12, 100.0, 3.25, 0.0)
    assert [r.at for r in G.out_of_range(rows, 13).collect()] == [4]
    assert tuple(G.first_and_last(rows, ["build"], "at", "stored").first()) == ("b", 1, 0, 4, 14, 4)


def test_parameters_and_milestones(spark):
    tensors = spark.createDataFrame([("embed", "embedding", "s1", 10), ("head", "output", "s1", 10), ("w", "layers", "s2", 5), ("v", "layers", "s3", 7)], "name string, part string, storage string, size int")
    assert {r.part: (r.parameters, r.tensors) for r in E.parameter_breakdown(tensors).collect()} == {"embedding": (10, 1), "layers": (12, 2)}
    assert E.milestones(9156, 3052) == [0, 3052, 6104, 9156] and E.milestones(10, 4, (7, 99)) == [0, 4, 7, 8, 10]
    with pytest.raises(ValueError):
        E.milestones(0, 1)
