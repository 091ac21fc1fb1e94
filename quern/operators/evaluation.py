"""Accounting and roll-ups of likelihood requests, training curves and their selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIKELIHOOD = ("loglikelihood", "multiple_choice")


def check_requests(requests: DataFrame) -> DataFrame:
    """Requests that cannot be scored, with the reason: not a likelihood request, or an empty continuation."""
    reason = F.when(~F.coalesce(F.col("request_type").isin(*LIKELIHOOD), F.lit(False)), "not a likelihood request").when(F.coalesce(F.col("n_continuation"), F.lit(0)) <= 0, "empty continuation")
    return requests.select("*", reason.alias("reason")).where("reason is not null")


def account(requests: DataFrame) -> DataFrame:
    """(request_id, request_type, task, doc_id, n_context, n_continuation) -> examples, continuations and tokens.

    An example is a (task, doc_id), or the request itself where doc_id is null.
    """
    example = F.when(F.col("doc_id").isNull(), F.concat(F.lit("instance:"), F.col("request_id"))).otherwise(F.concat_ws(":", F.lit("task"), F.coalesce("task", F.lit("")), F.col("doc_id")))
    total = F.col("n_context") + F.col("n_continuation")
    return requests.agg(F.count_distinct(example).alias("examples"), F.count(F.lit(1)).alias("continuations"), F.sum("n_continuation").alias("scored_tokens"), F.sum(total).alias("total_tokens"))


def _ranked(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, n, upto, all): how often each value occurs, up to it and in all, so that no group of rows is gathered."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy(value))).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))


def _rank(value: str, quantile: float) -> Column:
    """Aggregate over ``_ranked``: the value at rank round((all - 1) q), halves rounded to even."""
    if not 0.0 <= quantile <= 1.0:
        raise ValueError("quantile must be in [0, 1]")
    return F.min(F.when(F.col("upto") > F.bround((F.col("all") - 1) * F.lit(quantile)), F.col(value)))


def nearest_ranks(rows: DataFrame, value: str, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Exact order statistics of each group by nearest rank; null values don't count, a group without others has no row."""
    return _ranked(rows, value, by).groupBy(*by).agg(*[_rank(value, q).alias(n) for n, q in quantiles.items()])


def length_summary(requests: DataFrame, by: list[str]) -> DataFrame:
    """Count, sum, extremes, and median and 95th percentile by nearest rank, of context and continuation together."""
    ranks = _ranked(requests.withColumn("length", F.col("n_context") + F.col("n_continuation")), "length", by)
    return ranks.groupBy(*by).agg(F.sum("n").alias("requests"), F.sum(F.col("length") * F.col("n")).alias("tokens"), F.min("length").alias("least"), _rank("length", 0.5).alias("p50"), _rank("length", 0.95).alias("p95"), F.max("length").alias("most"))


def event_contexts(requests: DataFrame, max_context: int = 512) -> DataFrame:
    """(request_id, event, context): the context length of each scored token."""
    if max_context <= 0:
        raise ValueError("max_context must be positive")
    events = requests.where("n_continuation > 0").select("request_id", F.greatest(F.lit(1), F.col("n_context")).alias("h"), F.explode(F.sequence(F.lit(0), F.col("n_continuation") - 1)).alias("event"))
    return events.select("request_id", "event", F.least(F.lit(max_context), F.col("h") + F.col("event")).alias("context"))


def scoring_time(events: DataFrame, rates: dict[int, float]) -> DataFrame:
    """Optimistic, central and pessimistic seconds from measured tokens per second by context length.

    Each event takes the rate of the nearest measured length, the smaller of two as near; the rates are a few
    constants. No events take no time.
    """
    if not rates or any(r <= 0 for r in rates.values()):
        raise ValueError("at least one positive rate is needed")
    lengths = sorted(rates)
    nearest = F.lit(rates[lengths[-1]])
    for a, b in reversed(list(zip(lengths, lengths[1:]))):
        nearest = F.when(F.col("context") * 2 <= a + b, F.lit(rates[a])).otherwise(nearest)
    n = F.count(F.lit(1))
    return events.agg(n.alias("events"), (n / F.lit(max(rates.values()))).alias("optimistic"), F.coalesce(F.sum(F.lit(1.0) / nearest), F.lit(0.0)).alias("central"), (F.lit(1.5) * n / F.lit(min(rates.values()))).alias("pessimistic"))


def request_rollup(events: DataFrame) -> DataFrame:
    """(request_id, logprob, greedy) of scored tokens -> sum of log probabilities and whether all were greedy."""
    return events.groupBy("request_id").agg(F.sum("logprob").alias("logprob"), F.bool_and("greedy").alias("greedy"), F.count(F.lit(1)).alias("tokens"))


def weighted_loss(batches: DataFrame, by: list[str]) -> DataFrame:
    """(loss, tokens) -> token-weighted mean loss, its perplexity, and the tokens."""
    mean = F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")
    return batches.groupBy(*by).agg(mean.alias("loss"), F.exp(mean).alias("perplexity"), F.sum("tokens").alias("tokens"))


def accuracy(choices: DataFrame) -> DataFrame:
    """(task, doc_id, choice, logprob, n_bytes, is_label) -> accuracy by log probability, the same normalised by length, and its standard error.

    The best choice of a document is the one of the highest score, the smallest number of equals.
    """
    per = choices.groupBy("task", "doc_id").agg(F.max_by("is_label", F.struct("logprob", -F.col("choice"))).alias("hit"), F.max_by("is_label", F.struct(F.col("logprob") / F.greatest("n_bytes", F.lit(1)), -F.col("choice"))).alias("hit_norm"))
    x = F.col("hit").cast("double")
    return per.groupBy("task").agg(F.count(F.lit(1)).alias("docs"), F.avg(x).alias("acc"), F.avg(F.col("hit_norm").cast("double")).alias("acc_norm"), F.sqrt(F.avg(x) * (1 - F.avg(x)) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("stderr"))


def step_bins(rows: DataFrame, width: int = 1000) -> DataFrame:
    """(step, loss) -> first and last step and mean loss of each run of ``width`` steps; the last may be shorter."""
    return rows.groupBy(F.expr(f"(step - 1) div {width}").alias("bin")).agg(F.min("step").alias("start_step"), F.max("step").alias("end_step"), F.avg("loss").alias("mean_loss"))


def discontinuities(rows: DataFrame, batch_windows: int, batch_tokens: int, first: int = 1) -> DataFrame:
    """(step, next_window, tokens) rows that break the run: a step that doesn't follow another, or a wrong cursor or total.

    A step follows if the one before it is there, so no order over the whole table is needed.
    """
    steps = rows.select("step").distinct()
    before = steps.select((F.col("step") + 1).alias("step"), F.lit(True).alias("follows"))
    repeated = rows.groupBy("step").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    checked = rows.join(before, "step", "left").join(repeated, "step")
    bad = (F.col("follows").isNull() & (F.col("step") != first)) | F.col("repeated") | (F.col("next_window") != F.col("step") * batch_windows) | (F.col("tokens") != F.col("step") * batch_tokens)
    return checked.where(bad).select("step", "next_window", "tokens")


def joined_curves(general: DataFrame, edu: DataFrame) -> DataFrame:
    """Two (step, loss) curves over exactly the same steps; a step that one side lacks is an error."""
    both = general.select("step", F.col("loss").alias("general"), F.lit(True).alias("l")).join(edu.select("step", F.col("loss").alias("edu"), F.lit(True).alias("r")), "step", "full")
    if not both.where(F.col("l").isNull() | F.col("r").isNull()).isEmpty():
        raise RuntimeError("the curves differ in their steps")
    return both.select("step", "general", "edu", ((F.col("general") + F.col("edu")) / 2.0).alias("combined"))


def select_checkpoint(curve: DataFrame, from_step: int, tolerance: float) -> DataFrame:
    """The latest step, from ``from_step`` on, whose combined loss is within ``tolerance`` of the best."""
    late = curve.where(F.col("step") >= from_step)
    best = F.lit(late.agg(F.min("combined")).first()[0]).cast("double")
    near = late.where(F.col("combined") <= best + tolerance)
    return near.agg(F.max("step").alias("step"), F.max_by("combined", "step").alias("combined"), F.first(best).alias("best")).where("step is not null")


def next_milestone(steps: DataFrame, milestones: list[int]) -> DataFrame:
    """(step) -> the next milestone after it, or null."""
    return steps.withColumn("milestone", F.array_min(F.filter(F.array(*[F.lit(m) for m in sorted(milestones)]), lambda m: m > F.col("step"))))


def best_batch(trials: DataFrame) -> DataFrame:
    """(microbatch, tokens_per_second, status) -> the fastest that went well."""
    return trials.where("status = 'ok'").agg(F.max_by("microbatch", F.struct("tokens_per_second", -F.col("microbatch"))).alias("microbatch"), F.max("tokens_per_second").alias("tokens_per_second")).where("microbatch is not null")


def parameter_breakdown(tensors: DataFrame) -> DataFrame:
    """(name, part, storage, size) -> parameters of each part; tensors that share a storage count once, in the part of the first name."""
    once = tensors.groupBy("storage").agg(F.min_by("part", "name").alias("part"), F.min_by("size", "name").alias("size"))
    return once.groupBy("part").agg(F.sum("size").alias("parameters"), F.count(F.lit(1)).alias("tensors"))


def milestones(horizon: int, interval: int, boundaries: tuple[int, ...] = ()) -> list[int]:
    """Steps 0, interval, ... and the horizon, with the boundaries within it."""
    if horizon <= 0 or interval <= 0:
        raise ValueError("horizon and interval must be positive")
    return sorted({*range(0, horizon, interval), horizon, *(b for b in boundaries if 0 <= b <= horizon)})
