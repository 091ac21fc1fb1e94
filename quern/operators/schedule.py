"""Permutations of window ids, ranked by how much of a source they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import running_total


def ranked(counts: DataFrame, phase1: int, block: int) -> DataFrame:
    """(window_id, n) of every window -> with phase (PHASE1, LOW or HIGH) and position among its phase by id.

    The tail after ``phase1`` is ordered by (n, window_id); its first ``block`` windows are LOW, the rest HIGH.
    """
    tail = counts.where(F.col("window_id") >= phase1).withColumn("one", F.lit(1))
    order = running_total(tail, "one", ["n", "window_id"], "rank", label="rank")
    phases = counts.where(F.col("window_id") < phase1).select("window_id", "n", F.lit("PHASE1").alias("phase")).unionByName(order.select("window_id", "n", F.when(F.col("rank") < block, "LOW").otherwise("HIGH").alias("phase")))
    return running_total(phases.withColumn("one", F.lit(1)), "one", ["window_id"], "place", by=["phase"], label="phase").drop("one")


def schedules(phases: DataFrame, phase1: int, block: int) -> DataFrame:
    """(schedule, position, window_id) of static order, LOW then HIGH, and HIGH then LOW."""
    low = {"cooldown_edu": phase1, "precooldown_edu": phase1 + block}
    high = {"cooldown_edu": phase1 + block, "precooldown_edu": phase1}
    out = phases.select(F.lit("static").alias("schedule"), F.col("window_id").alias("position"), "window_id")
    for name in low:
        at = F.when(F.col("phase") == "PHASE1", F.col("window_id")).when(F.col("phase") == "LOW", F.col("place") + low[name]).otherwise(F.col("place") + high[name])
        out = out.unionByName(phases.select(F.lit(name).alias("schedule"), at.alias("position"), "window_id"))
    return out


def integrity(schedule_rows: DataFrame, total: int) -> DataFrame:
    """By schedule: whether positions and window ids are each exactly 0 .. total - 1."""
    def whole(c: str):
        return (F.min(c) == 0) & (F.max(c) == total - 1) & (F.count_distinct(c) == total) & (F.count(F.lit(1)) == total)

    return schedule_rows.groupBy("schedule").agg(F.count(F.lit(1)).alias("windows"), whole("position").alias("positions_ok"), whole("window_id").alias("permutation_ok"))


def distribution(phases: DataFrame, context: int) -> DataFrame:
    """By part of the tail: 10th and 90th percentile and median by interpolation; empty, full and mixed windows; mean share."""
    parts = phases.where("phase <> 'PHASE1'").withColumn("part", F.explode(F.array(F.lit("TAIL"), F.col("phase"))))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("windows"), F.percentile("n", F.lit(0.1)).alias("p10"), F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.9)).alias("p90"), F.count_if(F.col("n") == 0).alias("zero"), F.count_if(F.col("n") == context).alias("full"), F.count_if((F.col("n") > 0) & (F.col("n") < context)).alias("mixed"), (F.avg("n") / context).alias("share"))


def contrast(phases: DataFrame, context: int, least: float | None = None) -> float:
    """Difference of the mean shares of HIGH and LOW; an error if it is below ``least``."""
    by = {r.phase: r.m for r in phases.where("phase <> 'PHASE1'").groupBy("phase").agg(F.avg("n").alias("m")).collect()}
    value = (by.get("HIGH", 0.0) - by.get("LOW", 0.0)) / context
    if least is not None and value < least:
        raise RuntimeError(f"the phases differ by {value:.6f}, less than {least}")
    return value
