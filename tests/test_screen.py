import pytest
from pyspark.sql import functions as F

from quern.operators import corpus as C
from quern.operators import screen as X

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"
DOCS = [(1, f"prefix {ITEM} suffix"), (2, "orchards quietly measure the passing of every patient season in long rows"), (3, f"{ITEM} fourteen"), (4, None), (5, ""), (6, ITEM.upper().replace(" ", "\n")), (7, ITEM.replace("two", "two,"))]


def tables(spark):
    items = spark.createDataFrame([(1, ITEM), (2, f"{ITEM} fourteen"), (3, "too short"), (4, None)], "item_id int, text string")
    return spark.createDataFrame(DOCS, "doc_id int, text string"), X.build_index(items)


@pytest.mark.parametrize("shared", [500_000, 0])
def test_decisions(spark, shared):
    """Both ways of probing the index decide alike, and each document has a decision."""
    docs, index = tables(spark)
    assert index.count() == 2 and X.check_index(index).isEmpty()
    got = {r.id: r for r in X.decisions(docs, index, shared_digests=shared).collect()}
    assert {k: r.overlap_count for k, r in got.items()} == {1: 1, 2: 0, 3: 2, 4: 0, 5: 0, 6: 1, 7: 0}
    assert all(r.rejected == (r.overlap_count > 0) and r.overlap_hashes == sorted(r.overlap_hashes) and len(r.overlap_hashes) == r.overlap_count for r in got.values())
    assert "text" not in X.decisions(docs, index).columns


@pytest.mark.parametrize("filter_bytes", [1 << 26, 64])
def test_large_index_by_filter_and_exact_join(spark, monkeypatch, filter_bytes):
    """Only what the filter may hold is joined; a filter far too small, and rows that are no digest, change nothing."""
    monkeypatch.setattr("quern.functions.sketch.SEGMENT", 64)
    docs, index = tables(spark)
    more = spark.range(3000).selectExpr("unhex(sha2(cast(id as string), 256)) as value").unionByName(index.select("value"))
    dirty = more.unionByName(spark.createDataFrame([(None,), (b"",), (b"short",)], "value binary"))
    want = {(r.id, bytes(r.value)) for r in X.overlaps(docs, index).collect()}
    plain = index.select("value")
    assert want == {(r.id, bytes(r.value)) for r in X.overlaps(docs, plain).collect()} == {(r.id, bytes(r.value)) for r in X.overlaps(docs, index, shared_digests=1, filter_bytes=filter_bytes).collect()}
    assert want == {(r.id, bytes(r.value)) for r in X.overlaps(docs, dirty, shared_digests=100, filter_bytes=filter_bytes).collect()}


def test_screen_comes_before_the_split(spark):
    rows = spark.createDataFrame([("s", 1, 1, f"x {ITEM}", "train"), ("s", 2, 2, "clean text", "train"), ("s", 3, 3, "held out", "validation")], "source string, ordinal int, doc_id int, text string, split string")
    screened = X.screened(rows, tables(spark)[1])
    assert sorted(screened.collect()) == sorted(X.screened(rows, tables(spark)[1], shared_digests=0).select(*screened.columns).collect())
    assert [r.doc_id for r in screened.where(~F.col("rejected")).orderBy("doc_id").collect()] == [2, 3]
    assert tuple(X.counters(screened).first()) == ("s", 3, 2, 1, 1)


def test_index_union_and_violations(spark):
    index = tables(spark)[1]
    other = spark.createDataFrame([(bytes(32),), (bytes(32),), (index.first().value,)], "value binary")
    assert {r.new: r.n for r in X.extend_index(index, other).groupBy("new").agg(F.count("*").alias("n")).collect()} == {False: 2, True: 1}
    assert X.check_index(spark.createDataFrame([(None,), (b"x",), (bytes(32),)], "value binary")).count() == 2


def test_empty_index_and_documents(spark):
    docs, index = tables(spark)
    assert X.decisions(docs, index.limit(0)).where("rejected").isEmpty()
    assert X.decisions(docs.limit(0), index).isEmpty()


def test_benchmark_texts(spark):
    row = {"ctx_a": F.lit("a"), "ctx_b": F.lit(None).cast("string"), "endings": C.python_list_text(F.array(F.lit("x y"), F.lit("it's"), F.lit('both \' and "'), F.lit("back\\slash")))}
    got = spark.range(1).select(C.benchmark_text("hellaswag", row).alias("h"), C.benchmark_text("piqa", {"goal": F.lit("g"), "sol2": F.lit("s")}).alias("p"), C.benchmark_text("arc_easy", {"question": F.lit("q"), "choices": F.struct(F.array(F.lit("1"), F.lit("2")).alias("text"))}).alias("a"), C.benchmark_text("arc_easy", {"question": F.lit("q")}).alias("b"), C.benchmark_text("wikitext103", {}).alias("w")).first()
    assert got.h == f"a None  {['x y', chr(105) + 't' + chr(39) + 's', 'both ' + chr(39) + ' and ' + chr(34), 'back' + chr(92) + 'slash']}"
    assert (got.p, got.a, got.b, got.w) == ("g  s", "q 1 2", "q ", "")
    with pytest.raises(ValueError):
        C.benchmark_text("other", {})
