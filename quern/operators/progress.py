"""Telemetry of a build: derived rates, and the log's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import previous


def telemetry(rows: DataFrame, target: int, by: list[str], order: list[str]) -> DataFrame:
    """(stored, documents, seconds) records in order -> with percent, rates and remaining time; an unchanged count is no record.

    ``by`` are the builds, a few; a log of any length is read by many tasks.
    """
    changed = previous(rows, "stored", order, "was", by, label="telemetry").where(F.col("was").isNull() | (F.col("was") != F.col("stored"))).drop("was")
    rate = F.when(F.col("seconds") > 0, F.col("stored") / F.col("seconds")).otherwise(F.lit(0.0))
    return changed.select(
        "*",
        F.greatest(F.lit(0), F.col("stored") - 1).alias("prediction_tokens"),
        (F.lit(100.0) * F.col("stored") / target).alias("percent"),
        rate.alias("ids_per_second"),
        F.when(F.col("seconds") > 0, F.col("documents") / F.col("seconds")).otherwise(F.lit(0.0)).alias("documents_per_second"),
        F.when(rate > 0, (F.lit(target) - F.col("stored")) / rate).alias("remaining_seconds"),
    )


def out_of_range(rows: DataFrame, target: int) -> DataFrame:
    return rows.where(~F.coalesce(F.col("stored").between(0, target), F.lit(False)))


def first_and_last(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min(order).alias("first_at"), F.min_by(value, order).alias("first"), F.max(order).alias("last_at"), F.max_by(value, order).alias("last"), F.count(F.lit(1)).alias("records"))
