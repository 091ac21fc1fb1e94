import random

import pytest

from quern.llm import overlap
from quern.llm.words import words

SCHEMA = "doc_id bigint, text string, split string, source string, digest string, n int, t int"


def brute(rows):
    sets = {d: frozenset(zip(w, w[1:], w[2:])) for d, t, *_ in rows if t is not None and d is not None and len(w := words(t)) >= 20}
    split = {r[0]: (r[2] or "").strip().lower() for r in rows}
    out = set()
    for a, x in sets.items():
        for b, y in sets.items():
            if split[a] == "train" and split[b] in ("validation", "test") and 5 * len(x & y) >= 3 * len(x | y):
                out.add((min(a, b), max(a, b)))
    return out


def rows_of(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    phrases = [" ".join(r.choices(vocabulary, k=6)) for _ in range(12)]  # shared by many texts
    texts = [" ".join(r.choices(phrases, k=2) + r.choices(vocabulary, k=r.randint(5, 40))) for _ in range(n // 4)]
    out = []
    for k in range(n):
        w = r.choice(texts).split()
        for _ in range(r.choice([0, 0, 1, 2, 5, 9])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        text = " ".join(w) if r.random() > 0.05 else r.choice([None, "", "one two", " ".join(vocabulary[:19]), " ".join(vocabulary[:20])])
        out.append((k * 3 + 1, text, r.choice(["train", "TRAIN ", "train", "validation", " Test", None, "other"]), "s", "x", 1, 2))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_are_brute_force(spark, seed):
    rows = rows_of(seed)
    got = [tuple(x) for x in overlap.found(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_tiny_sketch_changes_nothing(spark, monkeypatch):
    """A sketch far too small makes more candidates, the same pairs."""
    monkeypatch.setattr(overlap.CountSketch, "width_for", staticmethod(lambda keys, most: 1 << 16))
    rows = rows_of(4)
    assert {tuple(x) for x in overlap.found(spark.createDataFrame(rows, SCHEMA), sketch_bytes=1 << 10).collect()} == brute(rows)


@pytest.mark.parametrize("frequent", [overlap.FREQUENT, 3])
def test_exact_counts_of_frequent_shingles(spark, monkeypatch, frequent):
    """A phrase in every text and cells shared by many shingles: saturated counts give way to exact ones, as many as may be sent."""
    from quern.functions import sketch

    monkeypatch.setattr(sketch, "SEGMENT", 64)
    rows = [(d, t and f"always the same few words {t}", *x) for d, t, *x in rows_of(6, 700)]
    got = [tuple(x) for x in overlap.found(spark.createDataFrame(rows, SCHEMA), sketch_bytes=128, frequent=frequent).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_divided_shingles_and_classes(spark, monkeypatch):
    """Whatever has more than two rows is joined in parts."""
    monkeypatch.setattr(overlap, "HOT_ROWS", 2)
    text = " ".join(f"h{k}" for k in range(40))
    rows = [(k, text, "train" if k % 3 else "test", "s", "x", 1, 2) for k in range(50)] + [(d, t and f"{t} one more phrase", *x) for d, t, *x in rows_of(7)[50:]]
    got = [tuple(x) for x in overlap.found(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_hot_class(spark):
    """A third of all rows are one text, on both sides: every pair comes out once."""
    text = " ".join(f"h{k}" for k in range(40))
    rows = [(k, text, "train" if k % 4 else "test", "s", "x", 1, 2) for k in range(60)] + rows_of(5)[60:]
    got = [tuple(x) for x in overlap.found(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert overlap.found(empty).collect() == []
    one_side = spark.createDataFrame([(1, " ".join(f"a{k}" for k in range(30)), "train", None, None, None, None), (None, "x", "test", None, None, None, None)], SCHEMA)
    assert overlap.found(one_side).collect() == []
    assert overlap.report(empty).collect() == []


def test_matches_are_counted_where_they_are_made(spark, monkeypatch):
    """Texts of few phrases match each other all over: no more than ids of classes and pairs are shuffled, and indexes and rounds of any size give the same pairs."""
    r = random.Random(8)
    phrases = [" ".join(f"p{k}w{j}" for j in range(6)) for k in range(12)]
    rows = [(k, " ".join(r.sample(phrases, 6)), "train" if k % 2 else "test", "s", "x", 1, 2) for k in range(300)]
    documents = spark.createDataFrame(rows, SCHEMA)

    def stages():
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteRecords() for x in map(found.apply, range(found.size()))}

    before = stages()
    first = [tuple(x) for x in overlap.found(documents).collect()]
    assert len(first) == len(set(first)) and set(first) == brute(rows)
    assert sum(n for k, n in stages().items() if k not in before) < 300 * 20
    monkeypatch.setattr(overlap, "BLOCK_GRAMS", 1000)
    monkeypatch.setattr(overlap, "MATCHES", 50)
    assert sorted(map(tuple, overlap.found(documents).collect())) == sorted(first)
