import random

import pytest
from pyspark.sql import functions as F

from quern.operators import corpus as C
from quern.operators import mixture as M

SCHEMA = "src int, ordinal bigint, doc_id bigint, document_id string, n_tokens int, text string, key int"


def sequential(rows, targets, stored_total):
    """The rule as a loop: (order of doc_ids, ids kept of each, skips by source); None if a source ends."""
    lists = [sorted((x for x in rows if x[0] == s), key=lambda x: x[1:3]) for s in (0, 1)]
    at, used, owner, skips, order, emitted = [0, 0], [0, 0], {}, [[0, 0], [0, 0]], [], 0
    while emitted < stored_total:
        s = 0 if emitted == 0 or used[0] * targets[1] <= used[1] * targets[0] else 1
        while True:
            if at[s] == len(lists[s]):
                return None
            x = lists[s][at[s]]
            at[s] += 1
            if x[3] not in owner:
                break
            skips[s][owner[x[3]] != s] += 1
        owner[x[3]] = s
        n = min(x[4] + 1, stored_total - emitted)
        order.append((x[2], emitted, n))
        used[s] += n - (emitted == 0)
        emitted += n
    return order, used, skips


def run(spark, rows, targets):
    own = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA).repartition(3)
    merged = M.merge(own, targets)
    emitted = M.emission(merged, sum(targets) + 1)
    if not M.exhausted(merged, emitted, targets).isEmpty():
        raise RuntimeError("exhausted")
    acc = {r.src: r for r in M.accounting(own, merged, emitted).collect()}
    order = [(r.doc_id, r.off, r.n) for r in emitted.orderBy("off").collect()]
    return order, [acc[s].prediction_ids if s in acc else 0 for s in (0, 1)], [[acc[s].intra_skips, acc[s].cross_skips] if s in acc else [0, 0] for s in (0, 1)]


def docs(source, names, n=3):
    return [(source, k, source * 1000 + k, d, n) for k, d in enumerate(names)]


def test_shared_document(spark):
    rows = docs(0, ["shared", "g1", "g2"]) + docs(1, ["shared", "e1"])
    order, used, skips = run(spark, rows, (8, 4))
    assert used == [8, 4] and skips == [[0, 0], [0, 1]] and len(order) == 4 and sum(n for *_, n in order) == 13


def test_copies_within_and_across_and_a_cut_document(spark):
    order, used, skips = run(spark, docs(0, ["a", "a", "c", "d"]) + docs(1, ["a", "e"]), (8, 4))
    assert used == [8, 4] and skips == [[1, 0], [0, 1]] and order[-1][2] == 1


def test_longer_targets_keep_the_prefix(spark):
    rows = docs(0, [f"f{k}" for k in range(20)]) + docs(1, [f"e{k}" for k in range(20)])
    short, long = run(spark, rows, (8, 4))[0], run(spark, rows, (24, 12))[0]
    assert [d for d, *_ in long[: len(short)]] == [d for d, *_ in short]


@pytest.mark.parametrize("seed", range(6))
def test_as_the_loop(spark, seed):
    r = random.Random(seed)
    ids = [f"d{k}" for k in range(25)]
    length = {d: r.randint(0, 9) for d in ids}
    rows = [(s, r.randrange(30), s * 100 + k, d, length[d]) for s in (0, 1) for k, d in enumerate(r.choices(ids, k=30))]
    k = r.choice([3, 8, 15])
    targets = r.choice([(2 * k, k), (k, k), (3 * k, 2 * k)])
    want = sequential(rows, targets, sum(targets) + 1)
    if want is None:
        with pytest.raises(RuntimeError):
            run(spark, rows, targets)
    else:
        order, used, skips = run(spark, rows, targets)
        assert order == want[0] and used == want[1] and skips == want[2]


@pytest.mark.parametrize("block", [50, M.BLOCK])
@pytest.mark.parametrize("step", [1, 2])
def test_many_shared_documents(spark, monkeypatch, block, step):
    """Two sources with the same documents in the same order, the second with all or every other one, settle exactly, over any blocks."""
    monkeypatch.setattr(M, "BLOCK", block)
    r = random.Random(step)
    names, length = [f"d{k}" for k in range(120)], [r.randint(0, 20) for _ in range(120)]
    rows = [(0, k, k, names[k], length[k]) for k in range(120)] + [(1, k, 1000 + k, names[k], length[k]) for k in range(0, 120, step)]
    order, used, skips = run(spark, rows, (150, 75))
    want = sequential(rows, (150, 75), 226)
    assert order == want[0] and used == want[1] and skips == want[2]


def whole_settlement(rows, targets):
    """Places lost by each source, by a loop over all documents."""
    lists, at, used, seen, lost = [[x for x in rows if x[0] == s] for s in (0, 1)], [0, 0], [0, 0], set(), set()
    while at[0] < len(lists[0]) or at[1] < len(lists[1]):
        keys = [(max(used[0] - 1, 0) * targets[1], 0), (used[1] * targets[0], 1)]
        s = min((k for k in keys if at[k[1]] < len(lists[k[1]])))[1]
        x = lists[s][at[s]]
        at[s] += 1
        if x[3] in seen:
            lost.add((s, x[3]))
        else:
            seen.add(x[3])
            used[s] += x[4] + 1
    return lost


@pytest.mark.parametrize("block", [1300, M.BLOCK])
def test_thousands_of_shared_documents_settle(spark, monkeypatch, block):
    """More than rounds of guessing could settle; every document has one owner, also behind the end of one source."""
    monkeypatch.setattr(M, "BLOCK", block)
    r = random.Random(5)
    length = [r.randint(0, 30) for _ in range(3000)]
    rows = [(0, k, k, f"d{k}", length[k]) for k in range(3000)] + [(1, k, 10_000 + k, f"d{k}", length[k]) for k in range(2900)]
    merged = M.merge(spark.createDataFrame([(*x, "t", 1) for x in rows], SCHEMA), (2, 1)).collect()
    assert {(x.src, x.document_id) for x in merged if not x.kept} == whole_settlement(rows, (2, 1))
    assert all(x.owner == (x.src if x.kept else 1 - x.src) for x in merged)


def test_a_source_that_ends_is_an_error(spark):
    with pytest.raises(RuntimeError):
        run(spark, docs(0, ["a"]) + docs(1, ["b", "c", "d", "e", "f"]), (8, 4))


@pytest.mark.parametrize("first, second", [(["a"], "bcdef"), ("abcdef", ["g"]), ("abcdef", []), ("abc", "bcdefg")])
def test_emission_itself_never_replaces_a_source(spark, first, second):
    """Both together have enough, one alone, or what the other leaves it, has not."""
    rows = docs(0, first) + docs(1, second)
    assert sequential(rows, (12, 6), 19) is None
    merged = M.merge(spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA), (12, 6))
    with pytest.raises(RuntimeError, match="source . ended"):
        M.emission(merged, 19)


def test_budgets(spark):
    rows = spark.createDataFrame([("train", k, k, "x" * 10) for k in range(10)] + [("validation", 3, 90, "yy")], "split string, ordinal int, doc_id int, text string")
    assert sorted(r.doc_id for r in C.byte_budget(rows, {"train": 25, "validation": 1}).collect()) == [0, 1, 2, 90]
    lengths = spark.createDataFrame([(k, k, 4) for k in range(10)], "ordinal int, doc_id int, n_tokens int")
    assert sorted(r.doc_id for r in C.token_budget(lengths, 10).collect()) == [0, 1, 2]
    with pytest.raises(RuntimeError):
        C.token_budget(lengths, 1000)
    capped = C.capped_tokens(lengths, 11, context=4).collect()
    assert sum(r.kept for r in capped) == 9
    assert C.token_budget(lengths.limit(0), 5, strict=False).isEmpty()


def test_first_in_source(spark):
    rows = spark.createDataFrame([("a", 2, 1, "x"), ("a", 1, 2, "x"), ("b", 9, 3, "x"), (None, 1, 4, "x")], "source string, ordinal int, doc_id int, document_id string")
    assert sorted(r.doc_id for r in M.first_in_source(rows).collect()) == [2, 3, 4]
    assert M.first_in_source(rows.where(F.lit(False))).isEmpty()


@pytest.mark.parametrize("seed", range(4))
def test_a_mixture_goes_on_from_its_state(spark, seed):
    """Stored in two parts it is what it is in one, though the first part ends within a document and rows come behind."""
    r = random.Random(20 + seed)
    ids = [f"d{k}" for k in range(60)]
    length = {d: r.randint(0, 9) for d in ids}
    rows = [(s, k, s * 100 + k, d, length[d]) for s in (0, 1) for k, d in enumerate(r.choices(ids, k=50))]
    short, targets = (8, 4), (40, 20)
    want = sequential(rows, targets, 61)
    if want is None:
        pytest.skip("a source ends")
    frame = lambda x: spark.createDataFrame([(*row, "t", 1) for row in x], SCHEMA)
    first = M.emission(M.merge(frame([x for x in rows if x[1] < 25]), short), 13)
    rest = M.extend(frame(rows), *M.state(first), targets, 61)
    both = [(x.doc_id, x.off, x.n) for x in first.where("n = stored").collect() + rest.collect()]
    assert sorted(both, key=lambda x: x[1]) == want[0]


@pytest.mark.parametrize("first, second, ended", [(["a"], "bcdef", 0), ("abcdef", ["g"], 1), ("abcdef", [], 1), ("abc", "bcdefg", 0), ("abcdef", "ghijkl", None)])
def test_which_source_ends(spark, first, second, ended):
    merged = M.merge(spark.createDataFrame([(*r, "t", 1) for r in docs(0, first) + docs(1, second)], SCHEMA), (12, 6))
    assert [r.src for r in M.first_to_end(merged, 19).collect()] == ([] if ended is None else [ended])


def test_plans(spark):
    M.check_plan(("a", "b"), ("a", "b"), (2, 1), 4)
    for bad in ((("b", "a"), ("a", "b"), (2, 1), 4), (("a", "b"), ("a", "b"), (2, 0), 3), (("a", "b"), ("a", "b"), (2, 1), 3), (("a", "b"), ("a", "b"), (2,), 3)):
        with pytest.raises(ValueError):
            M.check_plan(*bad)


def test_validation_budget_and_names(spark):
    rows = spark.createDataFrame([("train", 1, 1, 4), ("validation", 2, 2, 4), ("train", 3, 3, 4), ("validation", 4, 4, 4), ("train", 5, 5, 4), ("other", 2, 6, 4)], "split string, ordinal int, doc_id int, n_tokens int")
    assert sorted(r.doc_id for r in C.validation_budget(rows, 6).collect()) == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in C.validation_budget(rows, 2).collect()) == [1, 2]
    with pytest.raises(RuntimeError):
        C.validation_budget(rows, 10)
    names = spark.createDataFrame([(k, n) for k, n in enumerate(["x", "y", "x", None, "x", None])], "k int, name string")
    assert {r.k: r.unique_name for r in C.unique_names(names, "name", ["k"]).collect()} == {0: "x", 1: "y", 2: "x.1", 3: None, 4: "x.2", 5: None}
