import random

from quern.llm import sample

SCHEMA = "document_id string, split string, doc_id bigint, ingest_batch int, seq bigint, records int, h string"


def rows_of(seed, n=1500):
    r = random.Random(seed)
    out = []
    for k in range(n):
        i = f"{r.randrange(900):064x}"
        i = r.choice([i, i.upper(), f"sha256:{i}", f" {i} ", i, i]) if r.random() > 0.02 else None
        out.append((i, r.choice(["train", "train", "Train ", "test", None]), k, r.choice([1, 2, 3, 4, 5]), 1, 1, "x"))
    return out


def chosen(spark, rows, parts=3, rate=0.2):
    return {(x.document_id, x.split): x.seq for x in sample.sample(spark.createDataFrame(rows, SCHEMA).repartition(parts), rate).collect()}


def test_selected_records_stay_selected(spark):
    rows = rows_of(1)
    states = [chosen(spark, [x for x in rows if x[3] <= k]) for k in range(1, 6)]
    for before, after in zip(states, states[1:]):
        assert before.items() <= after.items()
    assert len(states[0]) < len(states[-1])


def test_rows_without_a_delivery_stay_too(spark):
    """Keys that name no delivery have numbers of their own, which no later delivery moves."""
    rows = [(f"{k:064x}", "train", k, 1 if k % 2 else None, 1, 1, "x") for k in range(60)]
    more = rows + [(f"{k:064x}", "train", k, 2, 1, 1, "x") for k in range(60, 77)]
    before, after = chosen(spark, rows), chosen(spark, more)
    assert before.items() <= after.items() and any(k >= 1 << 62 for k in before.values())


def test_numbers_in_a_table(spark, tmp_path):
    """Late rows, rows without a delivery and deliveries that come again change no number; numbers have no gap."""
    rows, path = rows_of(4), str(tmp_path / "numbers")
    late = [x for k, x in enumerate(rows) if k % 5 == 0]
    lacking = [(*x[:3], None, *x[4:]) for k, x in enumerate(rows) if k % 11 == 1]
    deliveries = [[x for x in rows if x[3] == k and x not in late] for k in (1, 2)] + [late, lacking, [x for x in rows if x[3] == 2], rows]
    before = {}
    for own in deliveries:
        for _ in range(2):
            got = sample.extend(spark.createDataFrame(own, SCHEMA).repartition(2), path).collect()
            now = {(x.document_id, x.split): x.seq for x in got}
            assert len(now) == len(got) and before.items() <= now.items()
            for s in {x.split for x in got}:
                assert sorted(x.seq for x in got if x.split == s) == list(range(sum(x.split == s for x in got)))
            before = now
    assert set(before) == {(x.document_id, x.split) for x in sample.sequence(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sample.extend(spark.createDataFrame([], SCHEMA), path).count() == len(before)
    assert 0 < sample.selected(sample.table(spark, path)).count() < len(before)


def test_same_on_every_layout_and_group_size(spark, monkeypatch):
    rows = rows_of(2)
    first = chosen(spark, rows, 1)
    assert chosen(spark, rows[::-1], 7) == first
    monkeypatch.setattr(sample, "GROUP_KEYS", 3)
    assert chosen(spark, rows, 4) == first


def test_even_coverage(spark):
    """Of any state of a split the share is met to within a few records."""
    df = spark.createDataFrame([(f"{k:064x}", "train", k, 1 + k % 5, None, None, None) for k in range(5000)], SCHEMA)
    for r in sample.growth(df).collect():
        assert abs(r.selected - sample.RATE * r.keys) < 5


def test_numbers_are_one_run_in_each_split(spark):
    got = sample.sequence(spark.createDataFrame(rows_of(3), SCHEMA)).collect()
    for s in {x.split for x in got}:
        assert sorted(x.seq for x in got if x.split == s) == list(range(sum(x.split == s for x in got)))
    assert sum(x.records for x in got) == 1500


def test_nulls_and_nothing(spark):
    assert sample.sample(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None, 1, None, None, None, None), (None, None, 2, None, None, None, None), (None, None, None, 1, None, None, None)]
    assert {x.document_id for x in sample.sequence(spark.createDataFrame(rows, SCHEMA)).collect()} == {"row:1", "row:2"}
