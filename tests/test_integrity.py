import json
import zipfile
from dataclasses import dataclass, replace
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quern.operators import integrity as I
from quern.sources import artifacts as A


def test_violations(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, float("inf")), (4, None), (5, 1.5)], "k int, v double")
    got = {(r.key, r.rule) for r in I.violations(rows, "k", {"finite": I.finite(F.col("v")), "share": I.share(F.col("v"))}).collect()}
    assert got == {("2", "finite"), ("3", "finite"), ("4", "finite"), ("2", "share"), ("3", "share"), ("4", "share"), ("5", "share")}


def test_manifest(spark, tmp_path):
    (tmp_path / "zeta.txt").write_text("z")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "alpha.txt").write_text("a")
    files = I.manifest(spark, str(tmp_path)).cache()
    assert {r.path: (r.bytes, r.sha256) for r in files.collect()} == {"zeta.txt": (1, sha256(b"z").hexdigest()), "sub/alpha.txt": (1, sha256(b"a").hexdigest())}
    I.write_manifest(files, str(tmp_path))
    lines = (tmp_path / "SHA256SUMS").read_text().splitlines()
    assert [x.split("  ")[1] for x in lines] == ["manifest.json", "sub/alpha.txt", "zeta.txt"]
    with pytest.raises(FileExistsError):
        I.write_manifest(files, str(tmp_path))
    (tmp_path / "zeta.txt").write_text("Z")
    (tmp_path / "new").write_text("n")
    (tmp_path / "sub" / "alpha.txt").unlink()
    again = I.manifest(spark, str(tmp_path), exclude=("SHA256SUMS", "manifest.json"))
    assert {(r.path, r.problem) for r in I.compare_manifests(files, again).collect()} == {("zeta.txt", "altered"), ("new", "added"), ("sub/alpha.txt", "missing")}
    assert I.compare_manifests(files, files).isEmpty()


def test_prefixes(tmp_path):
    p = tmp_path / "f"
    p.write_bytes(b"abcdefghi")
    I.verify_prefix(p, 6, sha256(b"abcdef").hexdigest())
    for n, text in ((6, b"abcdeg"), (10, b"abcdefghi"), (0, b"")):
        with pytest.raises((RuntimeError, ValueError)):
            I.verify_prefix(p, n, sha256(text).hexdigest())


def test_drift_and_gate(spark):
    schema = "off bigint, ids array<int>, source string"
    one = spark.createDataFrame([(0, [1, 2], "a"), (2, [3], "b"), (3, [4], None)], schema)
    other = spark.createDataFrame([(0, [1, 9], "a"), (2, [3], "a"), (9, [4], None)], schema)
    assert I.drift(one, one).isEmpty()
    assert {(r.off, r.problem) for r in I.drift(one, other).collect()} == {(0, "ids"), (2, "source"), (3, "missing"), (9, "added")}
    assert I.prefix_gate(one, one.where("off < 3"), ["off", "source"]).isEmpty()
    assert [r.off for r in I.prefix_gate(one, other, ["off", "ids"]).collect()].count(9) == 1


def test_configurations(spark):
    got = {r.path: (r.one, r.other) for r in I.config_difference(spark, {"a": {"b": 1, "c": [1]}, "id": 1}, {"a": {"b": 2, "c": [1]}, "id": 2, "n": None}, ("id",)).collect()}
    assert got == {"a.b": ("1", "2"), "n": (None, "null")}

    @dataclass(frozen=True)
    class Inner:
        x: int

    @dataclass(frozen=True)
    class Outer:
        name: str
        inner: dict
        y: int = 3

    assert A.construct(Outer, {"name": "n", "inner": {}}) == Outer("n", {})
    assert A.construct(Inner, {"x": 1}) == Inner(1)
    for bad in ({"name": "n"}, {"name": "n", "inner": {}, "z": 1}):
        with pytest.raises(ValueError):
            A.construct(Outer, bad)
    with pytest.raises(ValueError):
        A.SourceDescriptor("s", "p", "main")


def test_links(spark):
    page = "[a](x/y.md) ![i](<z%20z.png>) [w](https://e.org) [s](#top) [f](x/y.md#part)\n```\n[no](gone.md)\n```\n[g](gone2.md)"
    pages = spark.createDataFrame([(1, page), (2, None)], "id int, text string")
    assert sorted(r.target for r in I.links(pages).collect()) == ["gone2.md", "x/y.md", "x/y.md", "z z.png"]
    files = spark.createDataFrame([("x/y.md",), ("z z.png",)], "path string")
    assert [r.target for r in I.broken_links(pages, files).collect()] == ["gone2.md"]


def test_readers(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"event": "train", "step": 1}\n{"event": "run_start"}\n{"event": "train", "step": 2, "more": 1}\n')
    assert [r.step for r in A.read_jsonl(spark, str(p), "event string, step int", "train").orderBy("step").collect()] == [1, 2]
    p.write_text('{"event": \n')
    with pytest.raises(Exception):
        A.read_jsonl(spark, str(p), "event string").collect()
    I.write_json(tmp_path / "o.json", {"b": 1, "a": 2})
    assert (tmp_path / "o.json").read_text() == '{\n  "a": 2,\n  "b": 1\n}\n' and A.read_json_object(tmp_path / "o.json") == {"a": 2, "b": 1}
    (tmp_path / "list.json").write_text("[]")
    with pytest.raises(ValueError):
        A.read_json_object(tmp_path / "list.json")
    lock = {t: {"revision": "a" * 40, "splits": ["test"]} for t in ("x", "y")}
    (tmp_path / "lock.json").write_text(json.dumps(lock))
    assert [s.task for s in A.read_benchmark_lock(tmp_path / "lock.json", ("y", "x"))] == ["y", "x"]
    for tasks, change in ((("x",), {}), (("x", "y"), {"x": {"revision": "main", "splits": []}})):
        (tmp_path / "lock.json").write_text(json.dumps(lock | change))
        with pytest.raises(ValueError):
            A.read_benchmark_lock(tmp_path / "lock.json", tasks)
    spark.createDataFrame([(bytes(32),)], "value binary").write.parquet(str(tmp_path / "good"))
    spark.createDataFrame([(b"short",)], "value binary").write.parquet(str(tmp_path / "bad"))
    assert A.read_index(spark, str(tmp_path / "good")).count() == 1
    with pytest.raises(ValueError):
        A.read_index(spark, str(tmp_path / "bad"))


def test_sets_and_artifacts(spark):
    one = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    assert I.same_rows(one, one.select("v", "k").repartition(3)) and not I.same_rows(one, one.distinct())
    want = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "task string, sha256 string")
    got = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", "4")], "task string, sha256 string")
    assert {(r.task, r.problem) for r in I.match_artifacts(want, got).collect()} == {("y", "digest"), ("z", "missing"), ("w", "unexpected")}


def test_bundle(spark, tmp_path):
    stream = spark.createDataFrame([(0, 3, [1, 2, 3]), (3, 2, [4, 5])], "off bigint, n bigint, ids array<int>")
    A.write_stream(stream, str(tmp_path / "stream"), 5, chunk=2).collect()
    assert A.stream_sha256(str(tmp_path / "stream")) == sha256(b"".join(x.to_bytes(2, "little") for x in (1, 2, 3, 4, 5))).hexdigest()
    I.write_manifest(I.manifest(spark, str(tmp_path)), str(tmp_path))
    assert [x for r in A.load_bundle(spark, str(tmp_path), 2, visible=4).orderBy("off").collect() for x in r.ids] == [1, 2, 3, 4]
    (tmp_path / "stream" / "part-00000001.u16").write_bytes(b"12")
    with pytest.raises(RuntimeError):
        A.load_bundle(spark, str(tmp_path), 2)


def test_whole_bundle(spark, tmp_path):
    """Everything a bundle must be is checked, and all that is wrong is named at once."""
    stream = spark.createDataFrame([(0, 5, [1, 2, 3, 4, 5]), (5, 4, [6, 7, 8, 0])], "off bigint, n bigint, ids array<int>")
    calls = []
    A.write_stream(stream, str(tmp_path / "stream"), 9, chunk=4, progress=lambda part, n: calls.append((part, n)))
    assert calls == [(0, 4), (1, 8), (2, 9)]
    with pytest.raises(FileExistsError):
        A.write_stream(stream, str(tmp_path / "stream"), 9, chunk=4)
    (tmp_path / "tokenizer.json").write_text("{}")
    held_out = spark.createDataFrame([(1, [3, 4, 5, 6, 7]), (0, [1, 2, 3, 4, 5])], "window_id bigint, ids array<int>")
    for name in ("general", "edu"):
        held_out.coalesce(1).write.parquet(str(tmp_path / f"validation-{name}"))
    n, inputs, targets = A.windows_digests(held_out)
    assert n == 8 and inputs == sha256(b"".join(x.to_bytes(8, "little") for x in (1, 2, 3, 4, 3, 4, 5, 6))).hexdigest()
    raw = b"".join(x.to_bytes(2, "little") for x in (1, 2, 3, 4, 5, 6, 7, 8, 0))
    tokenizer, prefix = sha256(b"{}").hexdigest(), sha256(raw[:6]).hexdigest()
    manifest = {
        "id": "run-1",
        "mode": "full_stream",
        "dataset": {"repo": "r", "revision": "v"},
        "tokenizer": {"vocab_size": 8192, "special_tokens": ["<eod>"], "sha256": tokenizer},
        "stream": {"storage": "uint16", "context": 4, "non_cycled": True, "windows": 2, "prediction_tokens": 8, "stored_ids": 9, "bytes": 18, "sha256": sha256(raw).hexdigest()},
        "validations": {x: {"prediction_tokens": 8, "inputs_sha256": inputs, "targets_sha256": targets, "contamination_screened": True} for x in ("general", "edu")},
        "prefixes": {"first": {"ids": 3, "sha256": prefix, "match": True}},
        "mixture": {"deduplication": "canonical_content_sha256", "sources": ["a", "b"], "unique_documents": 2, "target_prediction_tokens": {"a": 5, "b": 3}, "actual_prediction_tokens": {"a": 5, "b": 3}},
    }
    manifest["files"] = [r.asDict() for r in I.manifest(spark, str(tmp_path)).collect()]
    want = A.Expected(("run-1",), {"repo": "r", "revision": "v"}, 8192, ("<eod>",), 4, 8, 8, tokenizer, None, ("edu",), {"general": (inputs, targets), "edu": None}, (("first", 3, prefix),), {"sources": ["a", "b"], "target_prediction_tokens": {"a": 5, "b": 3}})
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    bundle = A.open_bundle(spark, str(tmp_path), want, 4, visible=6)
    assert sorted(x for r in bundle.stream.collect() for x in r.ids) == [1, 2, 3, 4, 5, 6] and set(bundle.validations) == {"general", "edu"} and len(bundle.manifest_sha256) == 64

    def problems(change=(), **fields):
        own = json.loads(json.dumps(manifest))
        for path, value in change:
            at = own
            *front, last = path.split(".")
            for k in front:
                at = at[k]
            at[last] = value
        (tmp_path / "manifest.json").write_text(json.dumps(own))
        return A.bundle_problems(spark, str(tmp_path), replace(want, **fields))

    assert problems([("id", "x"), ("mode", "preparation"), ("dataset.revision", "w")]) == ["id", "mode", "dataset"]
    assert problems([("tokenizer.vocab_size", 1), ("stream.non_cycled", False), ("stream.stored_ids", 8), ("stream.sha256", "0")]) == ["vocabulary", "stream form", "stream size", "stream digest"]
    assert problems([("validations.edu.contamination_screened", False), ("validations.general.targets_sha256", "0"), ("prefixes.first.match", False)]) == ["prefix first in the manifest", "general validation digests", "edu validation not screened"]
    assert problems([("mixture.unique_documents", 0), ("mixture.actual_prediction_tokens.a", 4)]) == ["mixture", "mixture accounting"]
    assert problems(prefixes=(("first", 3, "0"),))[:1] == ["prefix first"] and problems(stream_sha256="0") == ["stream digest"] and problems(tokenizer_sha256="0") == ["tokenizer digest"]
    (tmp_path / "tokenizer.json").write_text("{ }")
    with pytest.raises(RuntimeError, match="tokenizer.json altered, tokenizer digest"):
        problems()
        A.open_bundle(spark, str(tmp_path), want, 4)


def test_a_stream_that_fails_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([(0, 2, [1, 2]), (1, 2, [3, 4])], "off bigint, n bigint, ids array<int>")  # overlap
    with pytest.raises(RuntimeError):
        A.write_stream(bad, str(tmp_path / "stream"), 4, chunk=2)
    assert not (tmp_path / "stream").exists()


def test_prefixes_that_may_fail(tmp_path):
    p = tmp_path / "f"
    p.write_bytes(b"abcdefghi")
    d = lambda n: sha256(b"abcdefghi"[:n]).hexdigest()
    assert I.prefix_matches(p, 4, d(4)) and not I.prefix_matches(p, 4, d(5)) and not I.prefix_matches(p, 10, d(9)) and not I.prefix_matches(p, 0, d(0))
    assert I.prefix_chain(p, [("a", 2, d(2)), ("b", 5, d(4)), ("c", 9, d(9)), ("d", 12, d(9))]) == ["b", "d"]
    with pytest.raises(ValueError):
        I.prefix_chain(p, [("a", 5, d(5)), ("b", 5, d(5))])


def test_durable_lines_and_all_rules(spark, tmp_path):
    for k in (2, 1):
        I.append_durable(tmp_path / "log", {"step": k, "a": None})
    assert (tmp_path / "log").read_text() == '{"a": null, "step": 2}\n{"a": null, "step": 1}\n'
    rows = spark.createDataFrame([(1, 0.5), (2, 3.0)], "k int, v double")
    got = I.all_violations({"x": (rows, "k", {"share": I.share(F.col("v")), "odd": F.col("k") % 2 == 1}), "y": (rows, "k", {"big": F.col("v") > 1})}).collect()
    assert sorted(map(tuple, got)) == [("x", "2", "odd"), ("x", "2", "share"), ("y", "1", "big")]


def test_link_destinations():
    text = '[a [b] c](one.md "title") ![x](<two three.md>) [p](four(1).md) `[no](code.md)` ``[no](`x`.md)``\n~~~~\n[no](in.md)\n~~~\n[no](still.md)\n~~~~\n[r]: five.md "t"\n[s]: <six seven.md>\n[open](never.md'
    assert I.link_targets(text) == ["five.md", "six seven.md", "one.md", "two three.md", "four(1).md"]
    assert I.link_targets("") == I.link_targets("[]() \\[x]") == []


def test_copy_of_an_index(spark, tmp_path):
    spark.createDataFrame([(bytes(32),), (b"\1" * 32,)], "value binary").write.parquet(str(tmp_path / "index"))
    assert A.copy_index(spark, str(tmp_path / "index"), str(tmp_path / "copy")).count() == 2
    with pytest.raises(Exception, match="already exists"):
        A.copy_index(spark, str(tmp_path / "index"), str(tmp_path / "copy"))


def test_zipped_records(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/train.jsonl", '{"q": "ä", "n": 1}\n\n{"q": null, "n": 2}')
        z.writestr("in/test.txt", "no json")
    rows = A.read_zipped_jsonl(spark, str(tmp_path / "a.zip"), "*.jsonl", "q string, n int")
    assert {tuple(r) for r in rows.collect()} == {("ä", 1), (None, 2)}
    assert A.read_zipped_jsonl(spark, str(tmp_path / "a.zip"), "*.other", "q string").isEmpty()
    with pytest.raises(Exception):
        A.read_zipped_jsonl(spark, str(tmp_path / "a.zip"), "in/*", "q string, n int").collect()
