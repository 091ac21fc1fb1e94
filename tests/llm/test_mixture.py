import random
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import mixture, tokens

DOCS, TARGETS = "doc_id bigint, text string, source string, lang string, copies int, step int, q double", "source string, weight double, max_repeats int, n_tokens int"


def tables(seed, n=1200):
    r = random.Random(seed)
    share = [("a", 60), ("A ", 5), ("b", 20), ("c", 4), ("rest", 8), (None, 1)]
    docs = [(k, r.choice([None, ""]) if r.random() < 0.02 else " ".join(r.choices(["one", "two", "```", "Q: x"], k=r.randint(1, 80))), r.choices([s for s, _ in share], [w for _, w in share])[0], r.choice(["en", "EN", "de", None]), 1, 1, 0.0) for k in range(n)]
    return docs, [("a", 0.5, 1, 1), ("B", 0.3, 2, 1), ("c", 0.1, 6, 1), ("absent", 0.1, 3, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_and_caps(spark, seed):
    docs, targets = tables(seed)
    got = mixture.documents_mixed(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)).collect()
    e = tokens.encoder()
    size, source = {d: len(e.encode(t or "")) for d, t, *_ in docs}, {d: (s or "").strip().lower() for d, _, s, *_ in docs}
    assert len({x.doc_id for x in got}) == len(got)
    by, cap = defaultdict(int), {s.lower(): c for s, _, c, _ in targets}
    for x in got:
        assert x.n_tokens == size[x.doc_id] > 0 and 1 <= x.copies <= cap[source[x.doc_id]]
        by[source[x.doc_id]] += x.n_tokens * x.copies
    whole = sum(by.values())
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(by[s] / whole - w / 0.9) < 0.01
    assert set(by) == {"a", "b", "c"}


@pytest.mark.parametrize("scarce, n", [(12, 30_000), (40, 20_000), (300, 20_000)])
def test_a_target_far_below_a_source_is_met_to_a_document(spark, scarce, n):
    """Probabilities of 0.0004, 0.002 and 0.015."""
    r = random.Random(n)
    text = lambda: " ".join(r.choices(["one", "two", "three"], k=r.randint(5, 20)))
    docs = [(k, text(), "a" if k < scarce else "b", r.choice(["en", "de"]), 1, 1, 0.0) for k in range(scarce + n)]
    got = mixture.documents_mixed(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 0.5, 1, 1), ("b", 0.5, 4, 1)], TARGETS)).collect()
    drawn = {s: sum(x.n_tokens * x.copies for x in got if x.source == s) for s in "ab"}
    assert len([x for x in got if x.source == "a"]) == scarce and abs(drawn["b"] - drawn["a"]) <= 10


def test_draws_meet_the_target_as_all_documents_sorted_would():
    r = random.Random(4)
    docs = [(r.randrange(3), r.randrange(mixture.STEPS), r.randint(1, 9)) for _ in range(4000)]
    q, cap = [0.3, 1.9, 0.004], 3
    for target in (1, 50, 999, 20_000, 33_333, 45_000):
        sums = [mixture.Sums() for _ in q]
        for k, x in enumerate(sums):
            x.below[-1] = sum(n for c, _, n in docs if c == k)
        draw = mixture.Draw(q, sums, cap, target)
        parts = {(k, 0) for k in range(3)}
        for above, shift in zip((31, *mixture.SHIFTS), mixture.SHIFTS):
            for k, x in enumerate(sums):
                counts = defaultdict(int)
                for c, step, n in docs:
                    if c == k and (k, step >> above) in parts:
                        counts[step >> shift] += n
                x.split(counts, shift)
            parts = {(k, start >> shift) for k, start in draw.narrow()}
        assert not parts or shift == 0
        thresholds = draw.met()
        got = sum(n * (thresholds[c] // mixture.STEPS + (step < thresholds[c] % mixture.STEPS)) for c, step, n in docs)
        assert abs(got - target) <= 5


def test_same_on_every_layout(spark):
    docs, targets = tables(3)
    t = spark.createDataFrame(targets, TARGETS)
    one = sorted(map(tuple, mixture.documents_mixed(spark.createDataFrame(docs, DOCS).repartition(1), t).collect()))
    assert one == sorted(map(tuple, mixture.documents_mixed(spark.createDataFrame(docs[::-1], DOCS).repartition(5), t).collect()))


def test_report_names_both_sides(spark):
    docs, targets = tables(4)
    rows = {x.source: x for x in mixture.shares(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)).collect()}
    assert set(rows) == {"a", "b", "c", "absent", "rest", None}
    assert rows["absent"].mixed_tokens == rows["rest"].mixed_tokens == 0 and abs(sum(x.share for x in rows.values()) - 1) < 1e-9


def test_given_topics_and_marginals(spark):
    """A topic column and weights of languages and topics: met exactly where the caps leave room, and the residuals say so."""
    r = random.Random(6)
    docs = [(k, " ".join(["w"] * r.randint(5, 30)), r.choice("ab"), r.choice(["en", "de"]), r.choice([0, 1]), 1, 0.0) for k in range(3000)]
    targets = spark.createDataFrame([("a", 0.5, 4, 1), ("b", 0.5, 4, 1)], TARGETS)
    options = {"topic_col": "copies", "marginals": {"lang": {"en": 3.0, "de": 1.0}, "topic": {"0": 1.0, "1": 1.0}}}
    rows = {(x.dimension, x.name): x for x in mixture.residuals(spark.createDataFrame(docs, DOCS), targets, **options).collect()}
    assert {k: round(x.target, 6) for k, x in rows.items()} == {("source", "a"): 0.5, ("source", "b"): 0.5, ("lang", "en"): 0.75, ("lang", "de"): 0.25, ("topic", "0"): 0.5, ("topic", "1"): 0.5}
    assert all(abs(x.residual) < (0.001 if x.dimension == "source" else 0.3) and abs(x.target - x.share - x.residual) < 1e-9 for x in rows.values())
    loose = spark.createDataFrame([("a", 1.0, 9, 1)], TARGETS)
    few = [d for d in docs if d[2] == "a"]
    far = {(x.dimension, x.name): x for x in mixture.residuals(spark.createDataFrame(few, DOCS), loose, **options).collect()}
    assert far["lang", "en"].share <= 0.75 + 1e-6 and far["source", "a"].rounds > 0
    with pytest.raises(ValueError):
        mixture.MOST_CELLS, most = 1, mixture.MOST_CELLS
        try:
            mixture.documents_mixed(spark.createDataFrame(docs, DOCS), targets, **options)
        finally:
            mixture.MOST_CELLS = most


def test_topics_are_learned_from_words_and_the_same_on_every_layout(spark):
    r = random.Random(7)
    kinds = [[f"{c}{k}" for k in range(40)] for c in "pqrs"]
    docs = [(k, " ".join(r.choices(kinds[k % 4], k=40) + ["the", "of"] * 9), "a", "en", 1, 1, 0.0) for k in range(600)]
    docs += [(1000 + k, t, "a", "de", 1, 1, 0.0) for k, t in enumerate([None, "", "x"])]
    one = {x.doc_id: (x.topic, x.n_tokens) for x in mixture.measured(spark.createDataFrame(docs, DOCS).repartition(1)).collect()}
    assert one == {x.doc_id: (x.topic, x.n_tokens) for x in mixture.measured(spark.createDataFrame(docs[::-1], DOCS).repartition(6)).collect()}
    assert [len({one[k][0] for k in range(600) if k % 4 == c}) for c in range(4)] == [1] * 4 and len({one[k][0] for k in range(600)}) == 4
    assert {one[k] for k in (1000, 1001)} == {("de-0", 0)}


def test_topics_are_those_of_all_documents(spark):
    """Of 10,000 documents only 12 are of the fourth kind, of a hash that a choice of 8,000 would leave out: they have a topic of their own."""
    late = {x.id for x in spark.range(10_000).where("pmod(xxhash64('quern-topic', id), 2147483648) > 1900000000").limit(12).collect()}
    docs = [(k, f"{c}1 {c}2 {c}3 {c}{k % 5 + 4}", "a", "en", 1, 1, 0.0) for k in range(10_000) for c in ["s" if k in late else "pqr"[k % 3]]]
    got = {x.doc_id: x.topic for x in mixture.measured(spark.createDataFrame(docs, DOCS)).collect()}
    own = {got[k] for k in late}
    assert len(late) == 12 and len(own) == 1 and not own & {got[k] for k in range(10_000) if k not in late}


def test_nothing(spark):
    docs, targets = tables(5)
    empty = spark.createDataFrame([], DOCS)
    assert mixture.documents_mixed(empty, spark.createDataFrame(targets, TARGETS)).collect() == []
    assert mixture.documents_mixed(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], TARGETS)).collect() == []
    assert mixture.shares(empty, spark.createDataFrame(targets, TARGETS)).count() == 4


def test_raking_meets_sources_exactly_and_languages_as_far_as_caps_allow():
    cells = [(s, lang, "t") for s in "ab" for lang in ("x", "y")]
    size = np.array([80.0, 20.0, 20.0, 80.0])
    q, total = mixture.rake(cells, size, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 2})
    used = q * size
    assert total == 400 and np.allclose([used[:2].sum(), used[2:].sum()], 200) and (q <= 2 + 1e-9).all()
    q, total = mixture.rake(cells, size, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3})
    used = q * size
    assert total == 200 and np.allclose([used[:2].sum(), used[2:].sum()], 100)
    assert mixture.rake(cells, size, {"z": 1.0}, {"z": 1})[1] == 0


def test_sums_of_many_tasks_are_merged_by_tasks(spark, monkeypatch):
    r = random.Random(8)
    docs = [(k, " ".join(r.choices([f"{'pqrs'[k % 4]}{j}" for j in range(20)], k=20)), "a", "en", 1, 1, 0.0) for k in range(400)]
    own = lambda: {x.doc_id: x.topic for x in mixture.measured(spark.createDataFrame(docs, DOCS)).collect()}
    one = own()
    monkeypatch.setattr(mixture.topics, "_PARTS", 0)
    assert own() == one
