"""The core queries: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import schedules as LR
from quern.functions import text as T
from quern.operators import corpus as C
from quern.operators import evaluation as E
from quern.operators import integrity as I
from quern.operators import mixture as M
from quern.operators import packing as P
from quern.operators import progress as G
from quern.operators import schedule as S
from quern.operators import screen as X
from quern.operators import tokenize as K
from quern.plans.runtime import materialize, read, shared_dir, ship_package
from quern.sources import artifacts as A
from quern.streaming import corpus as stream

Query = Callable[[SparkSession, str], DataFrame]

SOURCES = ("fineweb", "fineweb_edu")
EOD = 0
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    _QUERIES[f.__name__] = run
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _n_words(text):
    """The stand-in for a tokenizer where SQL must follow: pieces between single spaces."""
    return F.size(F.split(text, " "))


# --- identity, split, sizes


def _corpus(spark, d):
    return C.corpus(read(spark, d, "documents"))


def _identified(spark, d):
    return C.identified(read(spark, d, "documents"))


@query
def document_identity(spark, d):
    return _corpus(spark, d).select("doc_id", T.document_id(F.col("text")).alias("document_id"))


@query
def hash_split(spark, d):
    own = _corpus(spark, d).select("doc_id", T.document_id(F.col("text")).alias("document_id"))
    return own.select("doc_id", T.split_bucket(F.col("document_id")).alias("bucket"), T.hash_split(F.col("document_id")).alias("split"))


@query
def split_counts(spark, d):
    return _identified(spark, d).groupBy("source", "split").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("document_id").alias("distinct_documents"))


@query
def given_split_balance(spark, d):
    """How the hash split falls on the split a document came with."""
    given = read(spark, d, "documents").select("doc_id", C.source_name(F.col("split")).alias("given"))
    own = _identified(spark, d).select("doc_id", "split")
    return own.join(given, "doc_id").groupBy("given", "split").agg(F.count(F.lit(1)).alias("documents"))


@query
def text_metrics(spark, d):
    m = T.size_metrics(F.col("text"))
    return _corpus(spark, d).select("doc_id", *[(F.round(c, 6) if n.endswith("per_word") else c.cast("bigint")).alias(n) for n, c in m.items()])


@query
def benchmark_digests(spark, d):
    return T.source_text_digest(read(spark, d, "benchmark").select("item_id", "text")).select(F.col("id").alias("item_id"), "digest")


@query
def pretoken_counts(spark, d):
    """How often each pre-token occurs: what a vocabulary is read against."""
    return _corpus(spark, d).select(F.explode(K.pretokens(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("times"))


# --- screen


def _index(spark, d):
    return X.build_index(read(spark, d, "benchmark").select("item_id", "text"))


@query
def ngram_index_build(spark, d):
    return _index(spark, d).select(F.lower(F.hex("value")).alias("value"))


@query
def index_extension(spark, d):
    return X.extend_index(read(spark, d, "ngram_index"), _index(spark, d)).groupBy("new").agg(F.count(F.lit(1)).alias("digests"))


@query
def index_violations(spark, d):
    return X.check_index(read(spark, d, "ngram_hashes").select("arrival_id", "value")).select("arrival_id", F.octet_length("value").cast("bigint").alias("n_bytes"))


@query
def known_arrivals(spark, d):
    arrivals = read(spark, d, "ngram_hashes").select("arrival_id", C.source_name(F.col("source")).alias("source"), "value")
    known = arrivals.join(read(spark, d, "ngram_index"), "value", "left_semi")
    return known.groupBy("source").agg(F.count(F.lit(1)).alias("known"), F.count_distinct("value").alias("distinct_known"))


@query
def contamination_overlaps(spark, d):
    return X.overlaps(_corpus(spark, d).select("doc_id", "text"), _index(spark, d)).select(F.col("id").alias("doc_id"), F.lower(F.hex("value")).alias("value"))


@query
def contamination_decisions(spark, d):
    own = _corpus(spark, d)
    made = X.decisions(own.select("doc_id", "text"), _index(spark, d))
    ids = own.select("doc_id", T.document_id(F.col("text")).alias("document_sha256"))
    return ids.join(made.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "document_sha256", "rejected", "overlap_count", F.array_join("overlap_hashes", ",").alias("overlap_hashes"))


def _screened(spark, d):
    return X.screened(_identified(spark, d).withColumn("n_tokens", _n_words(F.col("text"))), _index(spark, d))


@query
def clean_documents(spark, d):
    return _screened(spark, d).where(~F.col("rejected")).select("doc_id")


@query
def contaminated_documents(spark, d):
    return _screened(spark, d).where("rejected").select("doc_id")


@query
def screen_counters_by_source(spark, d):
    return X.counters(_screened(spark, d))


@query
def decision_log_latest(spark, d):
    """The last decision on each document of the log of an earlier run; of equal times the one that rejects."""
    log = read(spark, d, "contamination_decisions").where("document_sha256 is not null")
    last = log.groupBy("document_sha256").agg(F.max(F.struct("decided_at", F.coalesce("rejected", F.lit(False)).alias("rejected"))).alias("x"), F.count(F.lit(1)).alias("decisions"))
    return last.select("document_sha256", F.col("x.rejected").alias("rejected"), "decisions")


@query
def decision_violations(spark, d):
    log = read(spark, d, "contamination_decisions")
    n = F.coalesce(F.size("overlap_hashes"), F.lit(0))
    rules = {"digest": F.col("document_sha256").rlike(r"\A[0-9a-f]{64}\z"), "count": F.col("overlap_count") == F.when(F.col("overlap_hashes").isNull(), 0).otherwise(n), "rejected": F.col("rejected") == (F.when(F.col("overlap_hashes").isNull(), 0).otherwise(n) > 0)}
    return I.violations(log, "document_sha256", rules).groupBy("key", "rule").agg(F.count(F.lit(1)).alias("times"))


# --- copies and budgets


@query
def dedup_first(spark, d):
    return M.first_in_source(_identified(spark, d).select("source", "ordinal", "doc_id", "document_id")).select("source", "doc_id", "document_id")


@query
def dedup_skip_counters(spark, d):
    return _identified(spark, d).groupBy("source").agg((F.count(F.lit(1)) - F.count_distinct("document_id")).alias("intra_skips"))


@query
def unique_documents(spark, d):
    return _identified(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source").alias("sources")).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("rows") > 1).alias("repeated"), F.count_if(F.col("sources") > 1).alias("in_several_sources"))


@query
def byte_budget_prefix(spark, d):
    """Of each split the documents that make up half of its bytes."""
    rows = _identified(spark, d)
    budgets = {r.split: r.n // 2 for r in rows.groupBy("split").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # two splits
    return C.byte_budget(rows, budgets or {"train": 0}).select("split", "doc_id", "n_bytes", "bytes_before")


def _train_lengths(spark, d):
    """(rows, half of their stored ids)"""
    rows = materialize(_identified(spark, d).where("split = 'train'").select("ordinal", "doc_id", _n_words(F.col("text")).alias("n_tokens")), "lengths")
    return rows, (rows.agg(F.sum(F.col("n_tokens") + 1)).first()[0] or 0) // 2


@query
def token_budget_prefix(spark, d):
    rows, half = _train_lengths(spark, d)
    return C.token_budget(rows, half, strict=half > 0).select("doc_id", "stored", "stored_before")


@query
def capped_token_prefix(spark, d):
    return C.capped_tokens(*_train_lengths(spark, d)).select("doc_id", "kept", "stored_before")


# --- mixture


def _mixture_rows(spark, d, screened=None):
    rows = (screened or _screened(spark, d)).where(F.col("source").isin(*SOURCES) & ~F.col("rejected") & (F.col("split") == "train"))
    slim = rows.select(F.when(F.col("source") == SOURCES[0], 0).otherwise(1).alias("src"), "ordinal", "doc_id", "document_id", "n_tokens")
    return materialize(slim, "mixture-input")


def _targets(rows) -> tuple[int, int]:
    """2 : 1, as large as nine tenths of what each source could give."""
    by = {r.src: r.n for r in rows.dropDuplicates(["src", "document_id"]).groupBy("src").agg(F.sum(F.col("n_tokens") + 1).alias("n")).collect()}
    k = min(by.get(0, 0) // 2, by.get(1, 0)) * 9 // 10
    return 2 * k, k


def _mixed(spark, d, screened=None):
    rows = _mixture_rows(spark, d, screened)
    targets = _targets(rows)
    M.check_plan(SOURCES, ("fineweb", "fineweb_edu"), targets, sum(targets) + 1)
    merged = materialize(M.merge(rows, targets), "mixture-merged")
    return rows, merged, M.emission(merged, sum(targets) + 1)


@query
def mixture_order(spark, d):
    return _mixed(spark, d)[2].select("src", "doc_id", "off", "n")


@query
def mixture_accounting(spark, d):
    return M.accounting(*_mixed(spark, d))


@query
def screen_counters_drawn(spark, d):
    """Counters over the rows the mixture drew: up to the last emitted document of each source."""
    screened = materialize(_screened(spark, d), "screened")
    last = _mixed(spark, d, screened)[2].groupBy("src").agg(F.max(F.struct("ordinal", "doc_id")).alias("last"))
    last = last.select(F.when(F.col("src") == 0, SOURCES[0]).otherwise(SOURCES[1]).alias("source"), "last")
    rows = screened.join(F.broadcast(last), "source").where(F.struct("ordinal", "doc_id") <= F.col("last"))
    return X.counters(rows)


# --- stream and windows


def _stream(spark, d):
    docs = read(spark, d, "token_docs").select("seq", C.source_name(F.col("source")).alias("source"), "ids")
    return P.offsets(docs, EOD)


def _stored(stream_rows) -> int:
    return stream_rows.agg(F.sum("n")).first()[0] or 0


@query
def stream_offsets(spark, d):
    return _stream(spark, d).select("seq", "source", "off", "n")


@query
def packed_windows(spark, d):
    x = P.examples(P.windows(_stream(spark, d).select("off", "n", "ids")))
    return x.select("window_id", F.sha2(F.array_join("inputs", ","), 256).alias("inputs"), F.sha2(F.array_join("targets", ","), 256).alias("targets"))


@query
def indexed_batch(spark, d):
    rows = materialize(_stream(spark, d).select("off", "n", "ids"), "stream")
    total = P.window_count(_stored(rows))
    wanted = spark.range(64).select(F.col("id").alias("place"), F.pmod(F.col("id") * 37 + 11, F.lit(total)).alias("window_id"))
    return P.indexed_batch(rows, wanted).select("place", "window_id", F.sha2(F.array_join("inputs", ","), 256).alias("inputs"), F.sha2(F.array_join("targets", ","), 256).alias("targets"))


@query
def contiguous_batch(spark, d):
    x = P.examples(P.windows(_stream(spark, d).select("off", "n", "ids"), wanted=spark.range(8, 24).select(F.col("id").alias("window_id"))))
    return x.select("window_id", F.element_at("inputs", 1).alias("first_input"), F.element_at("targets", -1).alias("last_target"))


def _counts(spark, d):
    rows = _stream(spark, d).select("off", "n", "source")
    rows = materialize(rows, "spans")
    return P.source_counts(rows, P.window_count(_stored(rows))), P.window_count(_stored(rows))


@query
def window_source_counts(spark, d):
    return _counts(spark, d)[0].select("window_id", "source", "n_targets")


@query
def window_digests(spark, d):
    return P.window_digests(P.windows(_stream(spark, d).select("off", "n", "ids")))


@query
def rolling_windows(spark, d):
    lengths = read(spark, d, "token_docs").where("ids is not null").select(F.col("seq").alias("id"), F.size("ids").alias("n")).distinct()
    return P.rolling_windows(lengths).groupBy("id").agg(F.count(F.lit(1)).alias("parts"), F.sum("scored").alias("scored"))


def _phases(spark, d):
    counts, total = _counts(spark, d)
    edu = counts.where(F.col("source") == SOURCES[1]).select("window_id", F.col("n_targets").alias("n"))
    every = spark.range(total).withColumnRenamed("id", "window_id").join(edu, "window_id", "left").na.fill(0, ["n"])
    block = total // 5
    return materialize(S.ranked(every, total - 2 * block, block), "phases"), total, block


@query
def window_schedule(spark, d):
    phases, total, block = _phases(spark, d)
    return S.schedules(phases, total - 2 * block, block)


@query
def schedule_integrity(spark, d):
    phases, total, block = _phases(spark, d)
    return S.integrity(S.schedules(phases, total - 2 * block, block), total)


@query
def low_high_distribution(spark, d):
    x = S.distribution(_phases(spark, d)[0], P.CONTEXT)
    return x.select("part", "windows", *[F.round(c, 6).alias(c) for c in ("p10", "median", "p90", "share")], "zero", "full", "mixed")


@query
def treatment_contrast(spark, d):
    value = S.contrast(_phases(spark, d)[0], P.CONTEXT)
    return spark.createDataFrame([(value,)], "contrast double").select(F.round("contrast", 9).alias("contrast"))


# --- requests and evaluation


def _requests(spark, d):
    n = F.when(F.length(F.coalesce("text", F.lit(""))) > 0, _n_words(F.col("text"))).otherwise(0)
    x = read(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), F.when(F.col("item_id") % 2 == 0, "loglikelihood").otherwise("multiple_choice").alias("request_type"), "task", F.when(F.col("item_id") % 7 != 0, F.expr("item_id div 3")).alias("doc_id"), n.alias("n"))
    return x.withColumn("n_context", F.expr("cast(n div 2 as int)")).withColumn("n_continuation", F.col("n") - F.col("n_context"))


@query
def request_violations(spark, d):
    return E.check_requests(_requests(spark, d)).select("request_id", "reason")


@query
def request_accounting(spark, d):
    return E.account(_requests(spark, d).where("n_continuation > 0"))


@query
def length_summary(spark, d):
    return E.length_summary(_requests(spark, d), ["task"])


@query
def event_context_lengths(spark, d):
    return E.event_contexts(_requests(spark, d), 64).groupBy("context").agg(F.count(F.lit(1)).alias("events"))


@query
def scoring_time_estimate(spark, d):
    x = E.scoring_time(E.event_contexts(_requests(spark, d)), {16: 800.0, 32: 410.0, 64: 200.0})
    return x.select("events", *[F.round(c, 6).alias(c) for c in ("optimistic", "central", "pessimistic")])


@query
def request_rollup(spark, d):
    events = read(spark, d, "events").select(F.col("user_id").alias("request_id"), (-F.col("value") / 100).alias("logprob"), (F.col("event_type") != "error").alias("greedy"))
    return E.request_rollup(events).select("request_id", F.round("logprob", 6).alias("logprob"), "greedy", "tokens")


@query
def weighted_loss(spark, d):
    x = E.weighted_loss(read(spark, d, "events").select("event_type", (F.col("value") / 100).alias("loss"), (1 + F.col("event_id") % 512).alias("tokens")), ["event_type"])
    return x.select("event_type", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"), "tokens")


@query
def bits_per_byte(spark, d):
    own = _corpus(spark, d).select("source", (_n_words(F.col("text")) * 3.5).alias("nll"), F.octet_length("text").alias("n_bytes"), _n_words(F.col("text")).alias("n"))
    return own.groupBy("source").agg(F.round(LR.perplexity(F.sum("nll") / F.sum("n")), 6).alias("perplexity"), F.round(LR.bits_per_byte(F.sum("nll"), F.sum("n_bytes")), 6).alias("bits_per_byte"))


@query
def task_accuracy(spark, d):
    x = read(spark, d, "benchmark").where("text is not null").select(F.expr("item_id div 4").alias("doc_id"), (F.col("item_id") % 4).alias("choice"), (-(F.length("text") % 97) / 10.0).alias("logprob"), F.octet_length("text").alias("n_bytes"), (F.col("item_id") % 3 == 0).alias("is_label"), F.lit("all").alias("task"))
    return E.accuracy(x).select("task", "docs", *[F.round(c, 9).alias(c) for c in ("acc", "acc_norm", "stderr")])


# --- schedules and curves


@query
def lr_cosine(spark, d):
    return spark.range(9157).select(F.col("id").alias("step"), F.round(LR.cosine_lr(F.col("id"), 6e-4, 6e-5, 100, 9156), 12).alias("lr"))


@query
def lr_wsd(spark, d):
    return spark.range(9157).select(F.col("id").alias("step"), F.round(LR.wsd_lr(F.col("id"), 6e-4, 6e-5, 100, 9156, 916), 12).alias("lr"))


@query
def adamw_retention(spark, d):
    run = spark.range(1, 9157).select(F.col("id").alias("step"), LR.wsd_lr(F.col("id"), 6e-4, 6e-5, 100, 9156, 916).alias("lr"))
    x = LR.retention(run, 0.1)

    def mean(a: int, b: int):
        return F.round(F.avg(F.when(F.col("step").between(a, b), F.col("coefficient"))), 9)

    return x.agg(F.max_by("step", "coefficient").alias("max_step"), mean(1, 7324).alias("phase1"), mean(7325, 8240).alias("phase2"), mean(8241, 9156).alias("phase3"))


@query
def run_arithmetic(spark, d):
    s = LR.run_state(F.col("step"), 32768, 512)
    plan = LR.remaining_updates(F.col("step"), 9156, F.when(F.col("step") % 2 == 0, F.lit(500)))
    x = spark.range(0, 9156, 763).select(F.col("id").alias("step"))
    return x.select("step", *[c.cast("bigint").alias(n) for n, c in s.items()], plan["updates"].cast("bigint").alias("updates"), plan["incomplete"].alias("incomplete"), LR.training_flops(F.lit(49860480), s["tokens"]).cast("string").alias("flops"))


def _steps(spark, d):
    return read(spark, d, "events").select((F.col("event_id") + 1).alias("step"), (F.col("value") / 100).alias("loss"), "event_type", "ts")


@query
def metrics_bins(spark, d):
    return E.step_bins(_steps(spark, d)).select("bin", "start_step", "end_step", F.round("mean_loss", 6).alias("mean_loss"))


@query
def step_continuity(spark, d):
    steps = _steps(spark, d).where(F.col("step") % 1009 != 0).select("step", (F.col("step") * 64 + (F.col("step") % 997 == 0).cast("int")).alias("next_window"), (F.col("step") * 32768).alias("tokens"))
    return E.discontinuities(steps, 64, 32768)


def _curve(spark, d):
    at = F.expr("(step - 1) div 200") * 200
    x = _steps(spark, d).withColumn("at", at)
    general = x.where("event_type <> 'error'").groupBy("at").agg(F.avg("loss").alias("loss")).withColumnRenamed("at", "step")
    edu = x.where("event_type = 'error'").groupBy("at").agg(F.avg("loss").alias("loss")).withColumnRenamed("at", "step")
    return E.joined_curves(general, edu)


@query
def validation_curve(spark, d):
    return _curve(spark, d).select("step", *[F.round(c, 6).alias(c) for c in ("general", "edu", "combined")])


@query
def checkpoint_selection(spark, d):
    return E.select_checkpoint(_curve(spark, d), 400, 0.05).select("step", F.round("combined", 6).alias("combined"), F.round("best", 6).alias("best"))


@query
def arm_classification(spark, d):
    e = read(spark, d, "events")

    def mean(kind: str):
        return F.avg(F.when(F.col("event_type") == kind, F.col("value"))) / 1000

    x = e.groupBy("user_id").agg(mean("view").alias("cg"), mean("click").alias("ce"), mean("purchase").alias("og"), mean("signup").alias("oe")).na.drop()
    c = LR.classify(*(F.col(k) for k in ("cg", "ce", "og", "oe")))
    return x.select("user_id", *[(F.round(v, 12) if n.startswith(("delta", "control", "other")) else v).alias(n) for n, v in c.items()])


@query
def next_milestone(spark, d):
    return E.next_milestone(spark.range(0, 9157, 109).select(F.col("id").cast("int").alias("step")), [0, 3052, 6104, 9156])


@query
def best_microbatch(spark, d):
    trials = read(spark, d, "events").groupBy((F.col("user_id") % 16).alias("microbatch")).agg(F.avg("value").alias("tokens_per_second"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return E.best_batch(trials.withColumn("status", F.when(F.col("microbatch") % 5 == 0, "oom").otherwise("ok"))).select("microbatch", F.round("tokens_per_second", 6).alias("tokens_per_second"))


# --- integrity and telemetry


@query
def guard_violations(spark, d):
    rules = {"value finite": I.finite(F.col("value")), "value a share": I.share(F.col("value") / 400), "type known": F.col("event_type").isin("view", "click", "purchase", "signup")}
    return I.violations(read(spark, d, "events"), "event_id", rules)


@query
def manifest_comparison(spark, d):
    own = read(spark, d, "documents").where("url is not null and text is not null").groupBy(F.col("url").alias("path")).agg(F.max(F.octet_length("text")).cast("bigint").alias("bytes"), F.max(F.sha2("text", 256)).alias("sha256"), F.max("doc_id").alias("doc_id"))
    expected = own.where("doc_id % 11 <> 0")
    found = own.where("doc_id % 13 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 17 == 0, F.lit("0")).otherwise(F.col("sha256")))
    return I.compare_manifests(expected, found)


@query
def stream_drift(spark, d):
    x = materialize(_stream(spark, d).select("seq", "off", "ids", "source"), "stream")
    replay = x.where("seq % 19 <> 0").withColumn("ids", F.when(F.col("seq") % 23 == 0, F.reverse("ids")).otherwise(F.col("ids"))).withColumn("source", F.when(F.col("seq") % 29 == 0, F.lit("other")).otherwise(F.col("source")))
    return I.drift(x, replay)


@query
def prefix_gate(spark, d):
    x = materialize(_stream(spark, d).select("seq", "off", "n"), "stream")
    shorter = x.where(F.col("off") < _stored(x) // 2).withColumn("n", F.when(F.col("seq") % 31 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return I.prefix_gate(x, shorter, ["seq", "off", "n"])


@query
def config_difference(spark, d):
    one = {"data": {"seed": 42, "cutoff": 200}, "training": {"steps": 9156, "lr": 0.0006}, "id": "a"}
    other = {"data": {"seed": 42, "cutoff": 100}, "training": {"steps": 9156, "lr": 0.0006, "cooldown": 916}, "id": "b"}
    return I.config_difference(spark, one, other, ("id",))


@query
def progress_telemetry(spark, d):
    rows = read(spark, d, "events").select("event_type", "event_id", F.floor(F.col("value") * 10).alias("stored"), (F.col("event_id") % 100).alias("documents"), (F.col("event_id") % 50).cast("double").alias("seconds"))
    x = G.telemetry(rows, 5000, ["event_type"], ["event_id"])
    return x.select("event_id", "stored", "prediction_tokens", *[F.round(c, 6).alias(c) for c in ("percent", "ids_per_second", "documents_per_second", "remaining_seconds")])


@query
def progress_first_last(spark, d):
    return G.first_and_last(read(spark, d, "events"), ["event_type"], "event_id", "value")


# --- streaming


def _drain(rows: DataFrame, spark: SparkSession, label: str) -> str:
    out = _place(spark, label)
    q = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{out}/rows"


@query
def stream_dedup(spark, d):
    """Distinct documents of the corpus, read as a stream of files."""
    schema = read(spark, d, "documents").schema
    rows = stream.first_seen(stream.read_stream(spark, f"{d}/documents.parquet*", schema)).select("document_id")
    return spark.read.schema("document_id string").parquet(_drain(rows, spark, "stream-dedup"))


def _by_day(spark, rows, label: str):
    out = _place(spark, label)
    x = stream.last_states(rows, ["start", "event_type"], f"{out}/rows", f"{out}/state")
    return x.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "records", F.round("total", 4).alias("total"))


@query
def stream_progress(spark, d):
    """Daily records by type from a stream of files; the watermark lets every row of the replayed log in."""
    schema = read(spark, d, "events").schema
    return _by_day(spark, stream.progress_by_window(stream.read_stream(spark, f"{d}/events.parquet*", schema), late="3650 days"), "stream-progress")


@query
def stream_late(spark, d):
    """The same log in three files, with a watermark of five days: rows of the third that it has passed are left out."""
    events, folder = read(spark, d, "events"), _place(spark, "stream-late-in")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{folder}/{k}")
    return _by_day(spark, stream.progress_by_window(stream.read_stream(spark, f"{folder}/*", events.schema), late="5 days"), "stream-late")


# --- files, gates and resumed work


def _place(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}-{label}-{uuid.uuid4().hex}"


FILE_IDS = 50_000


def _stream_file(spark, d):
    """The stored stream of valid ids as files: (rows, folder, listing)."""
    docs = read(spark, d, "token_docs").select("seq", C.source_name(F.col("source")).alias("source"), F.transform("ids", lambda x: F.pmod(x, F.lit(A.VOCABULARY))).alias("ids"))
    rows = materialize(P.offsets(docs, EOD).select("off", "n", "ids"), "stream")
    folder = _place(spark, "stream-files")
    return rows, folder, A.write_stream(rows, folder, _stored(rows), chunk=FILE_IDS)


@query
def stream_files(spark, d):
    """The files of a written stream: ids, and how many are stored up to each."""
    return _stream_file(spark, d)[2].select("part", "ids", "stored_so_far")


@query
def stream_file_manifest(spark, d):
    return I.manifest(spark, _stream_file(spark, d)[1])


@query
def stream_read_back(spark, d):
    """Ids, and the part of them that a bundle shows, read from the files again."""
    rows, folder, _ = _stream_file(spark, d)
    half = _stored(rows) // 2
    whole = A.read_stream(spark, folder, FILE_IDS).agg(F.sum("n").alias("ids"), F.sum(F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"))
    part = A.read_stream(spark, folder, FILE_IDS, visible=half).agg(F.sum("n").alias("visible_ids"), F.sum(F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("visible_total"))
    a, b = whole.first(), part.first()
    return spark.createDataFrame([(*a, *b)], "ids bigint, total bigint, visible_ids bigint, visible_total bigint")


@query
def stream_digest(spark, d):
    """SHA-256 of the whole stored stream."""
    return spark.createDataFrame([(A.stream_sha256(_stream_file(spark, d)[1]),)], "digest string")


@query
def prefix_gates(spark, d):
    """Prefixes of the written stream whose digests a chain of gates doesn't find; the second of three is told wrong."""
    rows, folder, _ = _stream_file(spark, d)
    store, base = A.FileSystem.from_uri(A.files_of(spark, folder)[0])
    with store.open_input_stream(f"{base}/part-{0:08d}.u16") as f:
        first = f.read()
    n = len(first) // 2
    links = [(name, x, hashlib.sha256(first[: 2 * x]).hexdigest() if name != "half" else "0" * 64) for name, x in (("quarter", n // 4), ("half", n // 2), ("whole", n))]
    broken = A.broken_prefixes(store, base, links)
    return spark.createDataFrame([(name, x, name not in broken) for name, x, _ in links], "name string, ids bigint, ok boolean")


@query
def index_copy(spark, d):
    copy = A.copy_index(spark, f"{d}/ngram_index.parquet", _place(spark, "index-copy"))
    return copy.agg(F.count(F.lit(1)).alias("digests"), F.count_distinct("value").alias("distinct_digests"))


@query
def jsonl_events(spark, d):
    """Records of one event from a log of JSON lines."""
    events, folder = read(spark, d, "events"), _place(spark, "log")
    events.select(F.col("event_type").alias("event"), "event_id", "value").write.json(folder)
    return A.read_jsonl(spark, folder, "event string, event_id bigint, value double", "click").select("event_id", "value")


@query
def window_set_digest(spark, d):
    """One digest of all windows in the order of their ids."""
    own = P.window_digests(P.windows(_stream(spark, d).select("off", "n", "ids")))
    return spark.createDataFrame([(P.set_digest(own, 64),)], "digest string")


@query
def first_example(spark, d):
    x = P.next_token_example(_stream(spark, d).select("off", "n", "ids"))
    return x.select("window_id", F.sha2(F.array_join("inputs", ","), 256).alias("inputs"), F.sha2(F.array_join("targets", ","), 256).alias("targets"))


@query
def scheduled_batch(spark, d):
    """Two batches of a schedule, the second from the cursor behind the first."""
    phases, total, block = _phases(spark, d)
    own = materialize(S.schedules(phases, total - 2 * block, block), "schedules")
    digest, size = "of the schedule", max(1, total // 8)
    one, cursor = P.Cursor.after(3, size, "cooldown_edu", digest).take(own, size, total, digest)
    two, _ = cursor.take(own, size, total, digest)
    return one.unionByName(two)


@query
def schedule_membership(spark, d):
    """Whether each schedule has just the windows of the static one."""
    phases, total, block = _phases(spark, d)
    own = materialize(S.schedules(phases, total - 2 * block, block), "schedules")
    names = [r.schedule for r in own.select("schedule").distinct().collect()]  # three
    ids = {n: own.where(F.col("schedule") == n).select("window_id") for n in names}
    return spark.createDataFrame([(n, I.same_rows(ids[n], ids["static"])) for n in names], "schedule string, same boolean")


@query
def capacity_lookup(spark, d):
    """Windows of each limit over each source, where its tokens are permitted."""
    own = read(spark, d, "token_docs").where("ids is not null").dropDuplicates(["seq"]).groupBy(C.source_name(F.col("source")).alias("artifact")).agg(F.sum(F.size("ids")).alias("n"))
    limits = read(spark, d, "size_limits").select(F.col("limit_name").alias("experiment"), "max_tokens")
    requests = own.select("artifact", F.expr("n div 512 * 512").alias("tokens")).withColumn("experiment", F.explode(F.array(*[F.lit(r.experiment) for r in limits.collect()])))  # a parameter table
    permitted = requests.where(F.length("artifact") % 2 == 0)
    return P.capacities(requests, permitted)


@query
def mixture_extension(spark, d):
    """The mixture stored by half, kept as ids and places, and then extended to the whole."""
    rows = _mixture_rows(spark, d)
    targets = _targets(rows)
    first = M.emission(materialize(M.merge(rows, targets), "mixture-merged"), sum(targets) // 2)
    owned, places = (materialize(x, "mixture-state") for x in M.state(first))
    rest = M.extend(rows, owned, places, targets, sum(targets) + 1)
    return first.where("n = stored").select("src", "doc_id", "off", "n").unionByName(rest.select("src", "doc_id", "off", "n"))


@query
def mixture_invariant(spark, d):
    """Stored predictions of each source, and whether they are the targets' together."""
    rows, merged, emitted = _mixed(spark, d)
    targets = _targets(rows)
    x = materialize(M.accounting(rows, merged, emitted).select("src", "prediction_ids"), "mixture-accounts")
    whole = x.agg(F.sum("prediction_ids")).first()[0] or 0
    return x.select("src", "prediction_ids", F.lit(sum(targets)).cast("bigint").alias("target"), F.lit(whole == sum(targets)).alias("complete"))


@query
def mixture_exhaustion(spark, d):
    """The source that ends first where the targets are more than there is."""
    rows = _mixture_rows(spark, d)
    by = {r.src: r.n for r in rows.dropDuplicates(["src", "document_id"]).groupBy("src").agg(F.sum(F.col("n_tokens") + 1).alias("n")).collect()}
    k = min(by.get(0, 0) // 2, by.get(1, 0)) * 13 // 10
    return M.first_to_end(materialize(M.merge(rows, (2 * k, k)), "mixture-merged"), 3 * k + 1)


@query
def validation_train_seen(spark, d):
    """Validation rows of half their tokens, and the train rows that stood before them."""
    rows = materialize(_identified(spark, d).select("split", "ordinal", "doc_id", _n_words(F.col("text")).alias("n_tokens")), "sizes")
    total = rows.where("split = 'validation'").agg(F.sum(F.col("n_tokens") + 1)).first()[0] or 0
    return (C.validation_budget(rows, total // 2) if total else rows.limit(0)).select("split", "doc_id")


@query
def text_token_metrics(spark, d):
    m = T.size_metrics(F.col("text"), _n_words(F.col("text")))
    return _corpus(spark, d).select("doc_id", *[F.round(m[n], 6).alias(n) for n in ("bytes_per_token", "chars_per_token", "tokens_per_word")])


@query
def encoded_digests(spark, d):
    """Ids by an encoder that is passed in: the length of each piece between single spaces."""
    rows = _corpus(spark, d).select("doc_id", "text")
    return K.encode(rows, lambda texts: [[len(x) for x in t.split(" ")] for t in texts]).select("doc_id", F.sha2(F.array_join("ids", ","), 256).alias("ids"))


@query
def benchmark_row_texts(spark, d):
    """Texts of benchmark rows of two tasks' columns, one of them absent."""
    b = read(spark, d, "benchmark")
    own = {"goal": F.col("task"), "sol1": F.col("text"), "sol2": F.col("split")}
    listed = F.array(F.col("task"), F.coalesce("split", F.lit("it's")))
    return b.select("item_id", F.sha2(C.benchmark_text("piqa", own), 256).alias("choice"), C.benchmark_text("hellaswag", {"ctx_a": F.col("task"), "endings": C.python_list_text(listed)}).alias("endings"))


@query
def crawl_filenames(spark, d):
    """A file name for each crawl by its time; equal times have suffixes."""
    own = read(spark, d, "documents").where("crawled_at is not null").select("doc_id", T.timestamp_filename(F.concat(F.date_format("crawled_at", "yyyy-MM-dd'T'HH"), F.lit(":00+00:00"))).alias("name"))
    return C.unique_names(own, "name", ["doc_id"]).select("doc_id", "unique_name")


@query
def commit_check(spark, d):
    """Which ids begin with what could be a full commit."""
    own = read(spark, d, "documents").where("document_id is not null")
    return own.select("doc_id", T.is_commit(F.substring("document_id", 1, 40)).alias("ok"))


@query
def artifact_match(spark, d):
    """Tasks and the digests of their items against a listing in which one lacks, one is altered and one is of no task."""
    b = read(spark, d, "benchmark").where("text is not null").groupBy("task").agg(F.sha2(F.min("text"), 256).alias("sha256"))
    names = sorted(r.task for r in b.select("task").collect())  # five
    found = b.where(F.col("task") != names[0]).withColumn("sha256", F.when(F.col("task") == names[1], F.lit("0")).otherwise(F.col("sha256")))
    return I.match_artifacts(b, found.unionByName(spark.createDataFrame([("other", "1")], "task string, sha256 string")))


@query
def evidence_errors(spark, d):
    """Every broken rule of three tables together."""
    log = read(spark, d, "contamination_decisions")
    events = read(spark, d, "events")
    targets = read(spark, d, "mix_targets")
    return I.all_violations({
        "decisions": (log, "document_sha256", {"digest": F.col("document_sha256").rlike(r"\A[0-9a-f]{64}\z"), "count": F.col("overlap_count") >= 0}),
        "events": (events, "event_id", {"value": I.finite(F.col("value")) & (F.col("value") < 200)}),
        "targets": (targets, "source", {"share": I.share(F.col("weight")), "repeats": F.col("max_repeats") > 1}),
    }).groupBy("table", "rule").agg(F.count(F.lit(1)).alias("errors"))


@query
def parameter_breakdown(spark, d):
    """Sizes by part, what shares a storage counted once."""
    x = read(spark, d, "part").select(F.format_string("%08d", F.col("p_partkey")).alias("name"), F.col("p_brand").alias("part"), F.expr("p_partkey div 2").alias("storage"), F.col("p_size").cast("bigint").alias("size"))
    return E.parameter_breakdown(x)


@query
def milestone_steps(spark, d):
    """Steps at which a run as long as the log has events is measured."""
    n = read(spark, d, "events").count()
    return spark.createDataFrame([(x,) for x in E.milestones(n, max(1, n // 9), (n // 3, n + 1, n // 2))], "step bigint")


@query
def broken_page_links(spark, d):
    """Links of pages made from the documents that lead to none of them."""
    docs = read(spark, d, "documents").select("doc_id")
    pages = docs.select(F.col("doc_id").alias("id"), F.format_string("See [this [page]](docs/%d.md#top \"title\"), [that](<docs/%d.md>) and `[none](x.md)`.\n~~~\n[no](gone.md)\n~~~\n", F.col("doc_id"), F.col("doc_id") + 1).alias("text"))
    return I.broken_links(pages, docs.select(F.format_string("docs/%d.md", "doc_id").alias("path"))).select(F.col("id").alias("doc_id"), "target")
