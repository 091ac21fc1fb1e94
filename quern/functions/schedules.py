"""Arithmetic of runs and evaluations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine_lr(step: Column, peak: float, least: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then a cosine down to ``least``; 0 at and before step 0."""
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(float(total - warmup)))
    return F.when(step <= 0, 0.0).when(step <= warmup, F.lit(peak) * step / warmup).otherwise(F.lit(least) + 0.5 * (peak - least) * (1.0 + F.cos(F.pi() * progress)))


def wsd_lr(step: Column, peak: float, least: float, warmup: int, total: int, cooldown: int) -> Column:
    """Linear warm-up, a plateau, and a cosine cool-down over the last ``cooldown`` steps."""
    if warmup <= 0 or cooldown <= 0 or total <= warmup + cooldown:
        raise ValueError("warm-up, plateau and cool-down must each have a step")
    stable = total - cooldown
    progress = (step - stable) / F.lit(float(cooldown))
    return F.when(step <= 0, 0.0).when(step <= warmup, F.lit(peak) * step / warmup).when(step <= stable, peak).when(step >= total, least).otherwise(F.lit(least) + 0.5 * (peak - least) * (1.0 + F.cos(F.pi() * progress)))


def retention(schedule: DataFrame, weight_decay: float) -> DataFrame:
    """(step, lr) -> (step, coefficient): what of each update is left at the end, as a share of the largest.

    The product over later steps is the exponential of a sum of logarithms. The schedule is one run's steps.
    """
    later = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    kept = F.exp(F.coalesce(F.sum(F.log1p(-F.col("lr") * weight_decay)).over(later), F.lit(0.0)))
    raw = schedule.withColumn("raw", F.col("lr") * weight_decay * kept)
    most = raw.agg(F.max("raw")).first()[0]
    return raw.select("step", (F.col("raw") / F.lit(most)).alias("coefficient"))


def perplexity(mean_nll: Column) -> Column:
    return F.exp(mean_nll)


def bits_per_byte(nll: Column, n_bytes: Column) -> Column:
    return nll / F.log(F.lit(2.0)) / n_bytes


# The published decision thresholds, in nat, and the names of the decisions.
WIN, TIE, REGRESSION = -0.020, 0.010, 0.020
DECISIONS = ("CAPABILITY WIN", "PERFORMANCE TIE", "REJECT WSD")


def classify(control_general: Column, control_edu: Column, other_general: Column, other_edu: Column) -> dict[str, Column]:
    """Combined losses, their differences, and the three-way decision with its guard against a single regression."""
    combined_control, combined_other = (control_general + control_edu) / 2.0, (other_general + other_edu) / 2.0
    general, edu, delta = other_general - control_general, other_edu - control_edu, combined_other - combined_control
    regressed = (general > REGRESSION) | (edu > REGRESSION)
    win, tie, reject = DECISIONS
    decision = F.when((delta <= WIN) & ~regressed, win).when(delta <= TIE, tie).otherwise(reject)
    return {"control_combined": combined_control, "other_combined": combined_other, "delta_general": general, "delta_edu": edu, "delta_combined": delta, "regressed": regressed, "classification": decision}


def run_state(step: Column, batch_tokens: int, sequence_tokens: int) -> dict[str, Column]:
    """Tokens and next window after a number of updates."""
    per = batch_tokens // sequence_tokens
    return {"tokens": step.cast("bigint") * batch_tokens, "next_window": step.cast("bigint") * per}


def remaining_updates(start: Column, horizon: int, most: Column) -> dict[str, Column]:
    """Updates of an invocation that may make ``most`` (null: all), and whether it stops before the horizon."""
    left = F.lit(horizon) - start
    return {"updates": F.least(left, F.coalesce(most, left)), "incomplete": F.coalesce(start + most < horizon, F.lit(False))}


def training_flops(parameters: Column, tokens: Column) -> Column:
    return F.lit(6).cast("decimal(38,0)") * parameters.cast("decimal(18,0)") * tokens.cast("decimal(18,0)")
