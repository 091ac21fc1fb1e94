"""Structured Streaming: first-seen documents, incremental extension, progress logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from quern.functions import text as T
from quern.operators.integrity import append_durable


def read_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 1, form: str = "parquet") -> DataFrame:
    """Files of a folder as they arrive, a bounded number a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(form).load(folder)


def first_seen(rows: DataFrame) -> DataFrame:
    """Rows with text whose document_id no earlier row had. State is one key a document and never expires: the rule has no horizon."""
    return rows.where(T.is_text(F.col("text"))).withColumn("document_id", T.document_id(F.col("text"))).dropDuplicates(["document_id"])


def extend_seen(batch: DataFrame, seen_path: str, batch_id: int) -> None:
    """foreachBatch sink: append the batch's new ids to a table of ids on shared storage; a batch that comes again replaces its own part."""
    spark = batch.sparkSession
    schema = "document_id string, doc_id bigint"
    own = batch.select("document_id", "doc_id").groupBy("document_id").agg(F.min("doc_id").alias("doc_id"))
    try:
        known = spark.read.schema(schema + ", batch bigint").parquet(seen_path).where(F.col("batch") != batch_id)
        own = own.join(known.select("document_id"), "document_id", "left_anti")
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    own.write.mode("overwrite").parquet(f"{seen_path}/batch={batch_id}")


def progress_by_window(rows: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Records, and sum and last value, by type and window of time; rows later than the watermark are left out."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("records"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "records", "total")


def append_jsonl(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append-only JSON lines, each batch complete or absent."""
    return rows.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def last_states(rows: DataFrame, keys: list[str], folder: str, checkpoint: str) -> DataFrame:
    """Drain a stream of aggregates in update mode; of each key the row of the last batch that changed it.

    Each batch writes its changes, once however often it runs, to the folder; state is dropped as the watermark passes.
    """
    spark = rows.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    write(spark.createDataFrame([], rows.schema), -1)  # a stream without a row has none
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(StructType([*rows.schema, StructField("batch", LongType())])).parquet(folder)
    rest = [c for c in rows.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_x")).select(*keys, "_x.*")


def log_progress(rows: DataFrame, path: str, checkpoint: str, every: int = 100) -> StreamingQuery:
    """Drain a stream of (step, ...) records; every ``every`` steps' last record is on disk, as a line of JSON, before the next batch runs.

    A batch that comes again after a failure may repeat its lines; readers take the last of a step.
    """
    if not 0 < every <= 100:
        raise ValueError("progress is kept every 1 to 100 steps")

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.where(F.col("step") % every == 0).orderBy("step")
        for r in kept.toLocalIterator():  # one in ``every`` records
            append_durable(path, r.asDict(recursive=True) | {"batch": batch_id})

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
