import random
import re

import numpy as np
import pytest

from quern.llm import leakage
from quern.llm.fmindex import FMIndex, WaveletMatrix, suffix_array
from quern.llm.words import words

DOCS, ITEMS = "doc_id bigint, text string, items string, spans int", "item_id bigint, text string, doc_id int"


def brute(docs, items, width=13):
    out = set()
    for i, t, *_ in items:
        w = words(t or "")
        grams = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
        for d, s, *_ in docs:
            v = words(s or "")
            if any(tuple(v[k : k + width]) in grams for k in range(len(v) - width + 1)):
                out.add((d, i))
    return out


def tables(seed):
    r = random.Random(seed)
    v = [f"v{k}" for k in range(30)]
    items = [(k, " ".join(r.choices(v, k=r.choice([0, 5, 12, 13, 14, 40]))), 1) for k in range(20)]
    items += [(97, items[3][1], 1), (98, None, 1), (99, "", 1)]
    docs = [(500, None, "x", 1), (501, "", "x", 1)]
    for k in range(120):
        w = r.choices(v + ["other", "more"], k=r.randint(0, 60))
        part = (r.choice(items)[1] or "").split() if r.random() < 0.5 else []
        a, at = r.randint(0, max(0, len(part) - 13)), r.randint(0, len(w))
        docs.append((k, r.choice([" ", "; ", "\n"]).join(w[:at] + part[a : a + r.choice([12, 13, 20])] + w[at:]), "x", 1))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("options", [{}, {"shard_words": 64}, {"block_chars": 300}])
def test_leaks_are_brute_force(spark, seed, options):
    docs, items = tables(seed)
    got = [tuple(x) for x in leakage.found(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **options).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)


@pytest.mark.parametrize("seed", [4, 5])
def test_rows_and_spans_whatever_the_blocks(spark, seed):
    docs, items = tables(seed)
    docs += docs[10:30]  # rows again
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    one = sorted(leakage.leaks(d, i).collect())
    assert len({r.doc_id for r in one}) == len(one) > 0
    assert one == sorted(leakage.leaks(d.repartition(5), i, block_chars=300).collect()) == sorted(leakage.leaks(d, i, block_chars=100, shard_words=50).collect())


def brute_chars(text, phrases, width=13):
    """Characters of each occurrence, by folding every word of the raw text."""
    w = [(m.group(), m.span()) for m in re.finditer(r"\S+", text)]
    low = [x for x, _ in w]
    return {k for a in range(len(w) - width + 1) if tuple(low[a : a + width]) in phrases for k in range(w[a][1][0], w[a + width - 1][1][1])}


def test_characters_are_brute_force_and_removal_cuts_them(spark):
    docs, items = tables(6)
    docs = [(d, t and re.sub(r"[;\n]", " ", t), *x) for d, t, *x in docs]
    phrases = {tuple(w[k : k + 13]) for _, t, _ in items if t for w in [t.split()] for k in range(len(w) - 12)}
    got = {r.doc_id: {k for s in r.chars for k in range(s.start, s.end)} for r in leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = {d: brute_chars(t, phrases) for d, t, *_ in docs if t}
    assert {d: len(c) for d, c in want.items() if c} == {d: len(c & want[d]) for d, c in got.items()}
    for d, c in got.items():  # touching passages are one span with the blanks between
        text = next(t for k, t, *_ in docs if k == d)
        assert all(text[k] == " " for k in c - want[d])
    rest = {r.doc_id: (r.text, r.removed) for r in leakage.removed(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    for d, t, *_ in docs:
        kept = t and "".join(x for k, x in enumerate(t) if k not in got.get(d, ()))
        assert rest[d] == (kept, None if t is None else len(t) - len(kept))


def test_spans_are_merged(spark):
    w = [f"q{k}" for k in range(30)]
    docs = [(1, "a b " + " ".join(w[:20]) + " c " + " ".join(w[10:23]), "x", 1)]
    row = leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, " ".join(w), 1)], ITEMS)).first()
    assert row.items == [7] and [tuple(s) for s in row.spans] == [(2, 22), (23, 36)]


def test_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, " ".join(map(str, range(20))), 1)], ITEMS)
    assert leakage.found(docs, items).collect() == leakage.found(docs, some).collect() == leakage.found(some.toDF("doc_id", "text", "x"), items).collect() == []


def test_index_against_scan():
    rng = np.random.default_rng(3)
    for _ in range(20):
        top = int(rng.integers(1, 6))
        s = np.append(rng.integers(0, top + 1, int(rng.integers(1, 300))), 0).astype(np.int32)
        index, patterns = FMIndex(s, top), rng.integers(1, top + 1, (40, int(rng.integers(1, 6))))
        for p, a, b in zip(patterns, *index.search(patterns)):
            want = [i for i in range(len(s) - len(p) + 1) if (s[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_long_repeats_and_ranks():
    s = np.array([1, 2, 3] * 400 + [0] + [1, 2, 3] * 400 + [0], np.int32)
    sa = suffix_array(s)
    assert sorted(sa.tolist()) == list(range(len(s)))
    tree = WaveletMatrix(s, 3)
    for c in (1, 2, 3):
        at = np.array([0, 1, 64, 65, 1200, len(s)])
        assert tree.rank(np.full(6, c), at).tolist() == [int((s[:i] == c).sum()) for i in at]
    assert (tree.access(np.arange(len(s))) == s).all()
