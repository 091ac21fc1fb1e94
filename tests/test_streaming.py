from pyspark.sql import functions as F

from quern.streaming import corpus as S

SCHEMA = "doc_id bigint, text string"


def write(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{k}")


def drain(rows, tmp_path, name):
    q = S.append_jsonl(rows, str(tmp_path / name), str(tmp_path / f"{name}-state"))
    q.awaitTermination()


def test_first_seen_across_files_and_restarts(spark, tmp_path):
    source = tmp_path / "in"
    write(spark, source, 1, [(1, "a"), (2, "b"), (3, " "), (4, None)])
    read = lambda: S.first_seen(S.read_stream(spark, f"{source}/*", SCHEMA))
    drain(read(), tmp_path, "out")
    write(spark, source, 2, [(5, "a"), (6, "c"), (7, "c")])
    drain(read(), tmp_path, "out")
    assert sorted(r.text for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_extension_is_repeatable(spark, tmp_path):
    seen = str(tmp_path / "seen")
    batch = lambda rows: spark.createDataFrame(rows, "document_id string, doc_id bigint")
    for _ in range(2):
        S.extend_seen(batch([("a", 1), ("b", 2), ("a", 3)]), seen, 0)
        S.extend_seen(batch([("a", 4), ("c", 5)]), seen, 1)
    assert sorted((r.document_id, r.doc_id) for r in spark.read.parquet(seen).collect()) == [("a", 1), ("b", 2), ("c", 5)]


def test_progress_windows(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'x' AS event_type, 1.5D AS value UNION ALL SELECT timestamp'2024-01-01 12:00:00', 'x', 2D UNION ALL SELECT timestamp'2024-01-03 00:00:00', 'x', 1D")
    rows.coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    out = S.progress_by_window(S.read_stream(spark, str(tmp_path / "in" / "*"), rows.schema))
    q = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("windows").select(F.date_format("start", "yyyy-MM-dd").alias("d"), "records", "total").collect()
    assert sorted(map(tuple, got)) == [("2024-01-01", 2, 3.5), ("2024-01-03", 1, 1.0)]


def test_last_states_and_late_rows(spark, tmp_path):
    """Changes of each batch are kept, the last one counts; rows that the watermark has passed are left out."""
    schema = "ts timestamp, event_type string, value double"
    files = [[("2024-01-05 10:00:00", "x", 1.0), ("2024-01-20 00:00:00", "x", 2.0)], [("2024-01-20 01:00:00", "x", 3.0)], [("2024-01-05 11:00:00", "x", 9.0), ("2024-01-21 00:00:00", "y", 4.0)]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) as ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    out = S.progress_by_window(S.read_stream(spark, str(tmp_path / "in" / "*"), schema), late="5 days")
    got = S.last_states(out, ["start", "event_type"], str(tmp_path / "rows"), str(tmp_path / "state")).select(F.date_format("start", "dd").alias("d"), "event_type", "records", "total").collect()
    assert sorted(map(tuple, got)) == [("05", "x", 1, 1.0), ("20", "x", 2, 5.0), ("21", "y", 1, 4.0)]


def test_progress_is_on_disk(spark, tmp_path):
    spark.range(1, 11).selectExpr("id as step", "id * 2 as tokens").coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    rows = S.read_stream(spark, str(tmp_path / "in" / "*"), "step bigint, tokens bigint")
    S.log_progress(rows, str(tmp_path / "log"), str(tmp_path / "state"), every=4).awaitTermination()
    assert (tmp_path / "log").read_text() == '{"batch": 0, "step": 4, "tokens": 8}\n{"batch": 0, "step": 8, "tokens": 16}\n'
