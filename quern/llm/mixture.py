"""Problem 8: mixing sources to target weights.

Iterative proportional fitting. Tokens are summed by cell (source, language, topic); cells are raked until the
source marginals equal the targets, with language and topic marginals as near to theirs as the caps allow, no cell being
repeated more often than its source may be. Language and topic have the targets they are given, else the corpus' own
shares; topics are those of a column, else learned (``topics``). A document's expected copies are its cell's;
the whole part is certain and the rest a probability met by a hash of the document. A source's copies are scaled
so that the drawn tokens, not the expected ones, meet the target to a document: token sums by steps of the hash tell
between which steps the target is met, and only these are split further, by another pass over the measured documents.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import tokens, topics
from quern.plans.runtime import materialize, spread

#: Steps of a probability.
STEPS = 1 << 31
#: Bits of a step that are not told apart by the first and each further pass: 256 sums for each cell, then for each part that is split.
SHIFTS = (23, 15, 7, 0)
CELL = ["source", "lang", "topic"]
LANGUAGES = ("en", "de", "es", "fr", "ru", "zh")
ROUNDS = 500
#: Most different cells, which the driver rakes; only topics that are given can be more, and that is an error.
MOST_CELLS = 20_000


def _measures(folder: str, vectors: bool):
    """(doc_id, text, ...) batches -> the same without text, with n_tokens and, if asked for, the vector of which topics are made."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = topics.Reader(folder)
        for b in batches:
            at = b.schema.get_field_index("text")
            both = [reader.read(t) for t in b.column(at).to_pylist()]
            rest = [k for k in range(b.num_columns) if k != at]
            out = [*(b.column(k) for k in rest), pa.array([n for n, _ in both], pa.int64()), *([pa.array([v for _, v in both], pa.binary())] if vectors else [])]
            yield pa.RecordBatch.from_arrays(out, names=[*(b.schema.names[k] for k in rest), "n_tokens", *(["vector"] if vectors else [])])

    return run


def _with_topics(shared):
    """(..., vector) batches -> the same with the topic instead."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(b.schema.get_field_index("lang")).to_numpy(zero_copy_only=False)
            found = shared.value.topics(langs, topics.matrix(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f"{x}-{k}" for x, k in zip(langs, found.tolist())], pa.string())], names=[*b.schema.names[:-1], "topic"])

    return run


def measured(documents: DataFrame, folder: str = tokens.TOKENIZERS, topic_col: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, step, n_tokens) of every document."""
    lang = F.lower(F.trim("lang"))
    given = [F.coalesce(F.col(topic_col).cast("string"), F.lit("")).alias("topic")] if topic_col else []
    own = spread(documents, "doc_id").select("doc_id", "text", F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", "")).alias("source"), F.when(lang.isin(*LANGUAGES), lang).otherwise("und").alias("lang"), F.pmod(F.xxhash64(F.lit("quern-mix"), "doc_id"), F.lit(STEPS)).cast("int").alias("step"), *given)
    schema = [*own.drop("text").schema, T.StructField("n_tokens", T.LongType())]
    if topic_col:
        return own.mapInArrow(_measures(folder, False), T.StructType(schema))
    vectors = materialize(own.mapInArrow(_measures(folder, True), T.StructType([*schema, T.StructField("vector", T.BinaryType())])), "p8-vectors")
    shared = documents.sparkSession.sparkContext.broadcast(topics.fit(vectors))
    return vectors.mapInArrow(_with_topics(shared), T.StructType([*schema, T.StructField("topic", T.StringType())]))


def _fill(q: np.ndarray, size: np.ndarray, cap: float, target: float) -> np.ndarray:
    """Scale q so that the sum of min(cap, scale q) size meets the target, as far as the cap lets it."""
    if target >= cap * size.sum():
        return np.full(len(q), cap)
    low, high = 0.0, 1.0
    while np.minimum(cap, high * q) @ size < target and high < 1e12:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(cap, mid * q) @ size < target else (low, mid)
    return np.minimum(cap, high * q)


def _raked(cells: list[tuple[str, str, str]], size: np.ndarray, weight: dict[str, float], cap: dict[str, int], wanted: dict[str, dict[str, float]]) -> tuple[np.ndarray, float, int, float]:
    """Expected copies, tokens of the whole, rounds, and the largest change of the last one."""
    source = np.array([c[0] for c in cells])
    own = {s: size[source == s].sum() for s in weight}
    live = [s for s in weight if own[s] > 0 and weight[s] > 0 and cap[s] > 0]
    if not live:
        return np.zeros(len(cells)), 0.0, 0, 0.0
    share = {s: weight[s] / sum(weight[x] for x in live) for s in live}
    total = min(cap[s] * own[s] / share[s] for s in live)
    most = np.array([cap[s] if s in share else 0 for s in source], float)
    use = most > 0
    q = np.where(use, 1.0, 0.0)
    parts = [(at, total * x) for k in (1, 2) for at, x in _marginal(cells, size, use, k, wanted.get(CELL[k]))]
    change, rounds = 0.0, 0
    for rounds in range(1, ROUNDS + 1):
        before = q.copy()
        for at, want in parts:
            if (have := q[at] @ size[at]) > 0:
                q[at] *= want / have
        for s in live:
            at = source == s
            q[at] = _fill(np.maximum(q[at], 1e-9), size[at], cap[s], share[s] * total)
        change = float(np.abs(q - before).max())
        if change < 1e-9:
            break
    return q, total, rounds, change


def _marginal(cells: list[tuple[str, str, str]], size: np.ndarray, use: np.ndarray, k: int, wanted: dict[str, float] | None) -> list[tuple[np.ndarray, float]]:
    """(cells, target share) of each name of a dimension: as wanted among those there are, else its own share."""
    names = np.array([c[k] for c in cells])
    there = [(use & (names == x), x) for x in np.unique(names[use])]
    weights = [max(0.0, wanted.get(x, 0.0)) if wanted else size[at].sum() for at, x in there]
    return [(at, w / sum(weights)) for (at, _), w in zip(there, weights)] if sum(weights) > 0 else []


def rake(cells: list[tuple[str, str, str]], size: np.ndarray, weight: dict[str, float], cap: dict[str, int], wanted: dict[str, dict[str, float]] = {}) -> tuple[np.ndarray, float]:  # noqa: B006
    """Expected copies of each cell's documents, and the tokens of the whole mixture.

    The whole is the largest for which no source needs more than its cap. Sources without a cell can give
    nothing; the others share its weight in proportion. ``wanted`` may give weights of ``lang`` and ``topic``.
    """
    return _raked(cells, size, weight, cap, wanted)[:2]


class Sums:
    """Tokens of a cell's documents below some steps, among them 0 and STEPS; those between two of them are yet to be split."""

    def __init__(self) -> None:
        self.steps, self.below = [0, STEPS], [0, 0]

    def split(self, counts: dict[int, int], shift: int) -> None:
        """Take the tokens of parts of 2 ** shift steps, every part that has any of the larger ones split."""
        known = dict(zip(self.steps, self.below))
        ends = sorted({*self.steps, *(part << shift for part in counts), *(part + 1 << shift for part in counts)})
        below = 0
        self.below = []
        for k, end in enumerate(ends):
            below = known.get(end, below + counts.get(ends[k - 1] >> shift, 0) if k else 0)
            self.below.append(below)
        self.steps = ends

    def drawn(self, threshold: int) -> tuple[int, int]:
        """The least and the most tokens drawn at a threshold, of STEPS for each copy."""
        whole, step = divmod(threshold, STEPS)
        k = bisect_right(self.steps, step) - 1
        least = whole * self.below[-1] + self.below[k]
        return least, least if self.steps[k] == step else least + self.below[k + 1] - self.below[k]

    def open(self, low: int, high: int) -> list[int]:
        """Where the parts with tokens begin that thresholds from low to high divide or pass."""
        out = set()
        for whole in range(low // STEPS, high // STEPS + 1):
            first, last = max(0, low - whole * STEPS), min(STEPS, high - whole * STEPS)
            for k in range(bisect_right(self.steps, first) - 1, len(self.steps) - 1):
                if self.steps[k] >= last:
                    break
                if self.below[k] < self.below[k + 1]:
                    out.add(self.steps[k])
        return sorted(out)


class Draw:
    """The scale of a source's expected copies at which the drawn tokens meet the target, between two bounds that close in."""

    def __init__(self, q: list[float], sums: list[Sums], cap: int, target: float) -> None:
        self.q, self.sums, self.cap, self.target = q, sums, cap, target
        self.full = sum(cap * x.below[-1] for x in sums) <= target * (1 + 1e-12)
        self.low, self.high = 0.0, 1.0
        while not self.full and self._drawn(self.high)[0] < target:
            self.high *= 2

    def thresholds(self, scale: float) -> list[int]:
        return [min(self.cap * STEPS, round(x * scale * STEPS)) for x in self.q]

    def _drawn(self, scale: float) -> tuple[int, int]:
        both = [x.drawn(t) for x, t in zip(self.sums, self.thresholds(scale))]
        return sum(least for least, _ in both), sum(most for _, most in both)

    def _close(self, which: int) -> tuple[float, float]:
        """Neighbouring scales within the bounds, at the second of which the least (0) or the most (1) drawn tokens reach the target."""
        low, high = self.low, self.high
        while low < (mid := (low + high) / 2) < high:
            low, high = (mid, high) if self._drawn(mid)[which] < self.target else (low, mid)
        return low, high

    def narrow(self) -> list[tuple[int, int]]:
        """(cell, beginning) of the parts that must be split to know more."""
        if self.full:
            return []
        self.low, self.high = self._close(1)[0], self._close(0)[1]
        return [(k, start) for k, (x, a, b) in enumerate(zip(self.sums, self.thresholds(self.low), self.thresholds(self.high))) for start in x.open(a, b)]

    def met(self) -> list[int]:
        """The cells' thresholds that draw nearest to the target."""
        if self.full:
            return [self.cap * STEPS] * len(self.q)
        below, above = self._drawn(self.low)[1], self._drawn(self.high)[0]
        return self.thresholds(self.low if self.target - below < above - self.target else self.high)


def plan(sizes: DataFrame, targets: DataFrame, marginals: dict[str, dict[str, float]] = {}) -> tuple[list, dict]:  # noqa: B006
    """(rows of (source, lang, topic, threshold), report)."""
    wanted = {}
    for r in targets.where("source is not null").collect():  # a parameter table
        name = r.source.strip().lower()
        wanted[name] = (wanted.get(name, (0, 0))[0] + max(0.0, r.weight or 0.0), max(wanted.get(name, (0, 0))[1], r.max_repeats or 0))
    own = sizes.where(F.col("source").isin(*wanted) & (F.col("n_tokens") > 0))

    def counts(of: DataFrame, shift: int) -> dict[tuple[str, str, str], dict[int, int]]:
        out: dict[tuple[str, str, str], dict[int, int]] = {}
        for r in of.groupBy(*CELL, F.shiftright("step", shift).alias("part")).agg(F.sum("n_tokens").alias("n")).collect():
            out.setdefault((r.source, r.lang, r.topic), {})[r.part] = r.n
        return out

    # at most sources of the target table x topics of all languages x 256 rows
    first = counts(own, SHIFTS[0])
    cells = sorted(first)
    sums = {c: Sums() for c in cells}
    for c in cells:
        sums[c].below[-1] = sum(first[c].values())
        sums[c].split(first[c], SHIFTS[0])
    size = np.array([sums[c].below[-1] for c in cells], float)
    q, total, rounds, change = _raked(cells, size, {s: w for s, (w, _) in wanted.items()}, {s: c for s, (_, c) in wanted.items()}, marginals)
    use = np.array([wanted[c[0]][1] > 0 and wanted[c[0]][0] > 0 for c in cells], bool)
    targets_of = [(CELL[k], cells[int(np.flatnonzero(at)[0])][k], share) for k in (1, 2) for at, share in _marginal(cells, size, use, k, marginals.get(CELL[k]))]
    live = sum(wanted[s][0] for s in {c[0] for c in cells} if wanted[s][1] > 0)
    draws = {}
    for s in sorted({c[0] for c in cells}):
        mine = [k for k, c in enumerate(cells) if c[0] == s]
        if q[mine].any():
            draws[s] = [cells[k] for k in mine], Draw(q[mine].tolist(), [sums[cells[k]] for k in mine], wanted[s][1], total * wanted[s][0] / live)
    for above, shift in zip(SHIFTS, SHIFTS[1:]):
        parts = [(*names[k], start >> above) for names, draw in draws.values() for k, start in draw.narrow()]
        if not parts:
            break
        # some parts a cell: those that the draw passes while the least that it can have drawn catches up with the most
        table = sizes.sparkSession.createDataFrame(parts, "source string, lang string, topic string, above int")
        for c, found in counts(own.withColumn("above", F.shiftright("step", above)).join(F.broadcast(table), [*CELL, "above"]), shift).items():
            sums[c].split(found, shift)
    rows = []
    for names, draw in draws.values():
        draw.narrow()
        rows += [(*c, x) for c, x in zip(names, draw.met())]
    targets_of += [(CELL[0], s, wanted[s][0] / live) for s in draws]
    return rows, {"total": total, "wanted": wanted, "rounds": rounds, "change": change, "targets": targets_of}


def mixture(documents: DataFrame, targets: DataFrame, *, topic_col: str | None = None, marginals: dict[str, dict[str, float]] = {}) -> tuple[DataFrame, DataFrame, dict]:  # noqa: B006
    """(chosen documents, all documents measured, plan)"""
    spark = documents.sparkSession
    sizes = materialize(measured(documents, topic_col=topic_col), "p8-sizes")
    if topic_col and sizes.select(*CELL).distinct().count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of source, language and topic")
    cells, about = plan(sizes, targets, marginals)
    table = spark.createDataFrame(cells, "source string, lang string, topic string, threshold bigint")
    sampled = (F.col("step") < F.col("threshold") % STEPS).cast("int")
    chosen = sizes.where("n_tokens > 0").join(F.broadcast(table), CELL).withColumn("copies", (F.floor(F.col("threshold") / STEPS) + sampled).cast("int")).where("copies > 0")
    return chosen.select("doc_id", "source", "lang", "topic", "n_tokens", "copies"), sizes, about


def documents_mixed(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, copies) of each document in the mixture.

    Sources are compared without case and outer blanks; documents of a null source or one without a target are
    left out, as are null and empty texts, which have no tokens. Repeated texts are documents like others. An
    empty table, or no target, gives no rows. Other columns play no part, but for ``topic_col``. ``marginals`` may give weights
    of languages (``lang``) and topics; a name without a weight then counts as weight 0, one that no document has is left out.
    """
    return mixture(documents, targets, **options)[0]


def shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """By source of either side: target weight, tokens there are, tokens in the mixture, actual share, repeats."""
    spark = documents.sparkSession
    chosen, sizes, about = mixture(documents, targets)
    there = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("available_tokens"))
    mixed = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("mixed_documents"))
    wanted = spark.createDataFrame([(s, float(w), int(c)) for s, (w, c) in about["wanted"].items()], "source string, weight double, max_repeats int")
    whole = mixed.agg(F.sum("mixed_tokens")).first()[0] or 1
    out = wanted.join(there, "source", "full").join(mixed, "source", "left").na.fill(0, ["documents", "available_tokens", "mixed_tokens", "most_copies", "mixed_documents"])
    return out.withColumn("share", F.col("mixed_tokens") / F.lit(whole)).withColumn("repeats", F.col("mixed_tokens") / F.greatest("available_tokens", F.lit(1)))


def residuals(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """Of each source, language and topic there is: its target share, its share of the mixture's tokens, what is missing, and the rounds of fitting with the last change."""
    chosen, _, about = mixture(documents, targets, **options)
    spark = documents.sparkSession
    sums = materialize(chosen.groupBy(*CELL).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens")), "p8-cells")
    whole = sums.agg(F.sum("tokens")).first()[0] or 1
    mixed = None
    for c in CELL:
        part = sums.groupBy(F.lit(c).alias("dimension"), F.col(c).alias("name")).agg((F.sum("tokens") / F.lit(whole)).alias("share"))
        mixed = part if mixed is None else mixed.unionByName(part)
    wanted = spark.createDataFrame([(d, n, float(x)) for d, n, x in about["targets"]], "dimension string, name string, target double")
    out = wanted.join(mixed, ["dimension", "name"], "left").na.fill(0.0, ["share"])
    return out.select("*", (F.col("target") - F.col("share")).alias("residual"), F.lit(about["rounds"]).alias("rounds"), F.lit(about["change"]).alias("last_change"))


def checks(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each target: documents repeated beyond its cap, and whether its share of the mixture's tokens is met to the largest document."""
    chosen, sizes, about = mixture(documents, targets)
    spark = documents.sparkSession
    wanted = spark.createDataFrame([(s, float(w), int(c)) for s, (w, c) in about["wanted"].items()], "source string, weight double, max_repeats int")
    there = sizes.where("n_tokens > 0").groupBy("source").agg(F.max("n_tokens").alias("largest"))
    mixed = chosen.join(F.broadcast(wanted), "source").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_cap"))
    whole = mixed.agg(F.sum("tokens")).first()[0] or 1
    out = wanted.join(there, "source", "left").join(mixed, "source", "left")
    live = wanted.join(there, "source", "left_semi").agg(F.sum("weight")).first()[0] or 1.0
    met = F.abs(F.coalesce("tokens", F.lit(0)) - F.col("weight") / F.lit(live) * F.lit(whole)) <= F.lit(1.0) * F.col("largest") * F.col("max_repeats")
    return out.select("source", "weight", F.coalesce("over_cap", F.lit(0)).alias("over_cap"), F.coalesce(met, F.lit(False)).alias("met"))
