"""Problem 9: splitting oversized texts at natural boundaries.

The words of a text carry prefix sums of their tokens, and a sorted array of boundaries with the end of each
paragraph, line and sentence. A piece begins ``overlap`` tokens before the end of the last one; its end is found by
binary search: the last strong boundary under the limit, wherever it lies behind the last piece's end and the overlap,
else the last word end, else a hard cut between two tokens. A sentence may end in closing quotes and brackets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import encode, tokens
from quern.plans.runtime import materialize, spread

_SENTENCE = (".", "!", "?", "…", "。", "！", "？")
#: What may stand between the end of a sentence and the boundary.
_CLOSING = "\"'”’»›)]}」』）】〉》"

SCHEMA = "limit_name string, doc_id bigint, piece int, start_token int, end_token int, start_char int, end_char int, cut string"


class Splitter:
    """Cuts one text after another; a text is encoded once for all limits."""

    def __init__(self, folder: str = tokens.TOKENIZERS) -> None:
        self._encoder = tokens.encoder(folder)
        self._count = tokens.WordCounts(self._encoder).__getitem__

    def load(self, text: str) -> int:
        """Take a text; its tokens."""
        self.words = self._encoder.split(text)
        self.tokens = [0, *accumulate(map(self._count, self.words))]  # at the start of each word, and at the end
        self.chars, self._inner = None, {}
        return self.tokens[-1]

    def _prepare(self) -> None:
        self.chars = [0, *accumulate(map(len, self.words))]
        strong = []
        last = len(self.words)
        for k in range(1, last):  # boundary before word k
            w, nxt = self.words[k - 1], self.words[k]
            if "\n" in w or "\r" in w:
                if not nxt.isspace():
                    strong.append(k)
            elif (bare := w.rstrip(_CLOSING)).endswith(_SENTENCE) and (nxt[:1].isspace() or bare[-1] in "。！？") and not ("\n" in nxt or "\r" in nxt):
                strong.append(k)
        self.strong = strong
        self.strong_tokens = [self.tokens[k] for k in strong]

    def _inside(self, word: int) -> tuple[list[int], list[int]]:
        """Token and character offsets within a word, both ends included, at which a character begins."""
        if word in self._inner:
            return self._inner[word]
        text = self.words[word]
        at_byte, b = {0: 0}, 0
        for k, c in enumerate(text):
            b += len(c.encode("utf-8", "surrogatepass"))
            at_byte[b] = k + 1
        out, b = ([0], [0]), 0
        for t, n in enumerate(self._encoder.lengths(text)):
            b += n
            if b in at_byte:
                out[0].append(t + 1)
                out[1].append(at_byte[b])
        self._inner[word] = out
        return out

    def _at_or_before(self, token: int) -> tuple[int, int]:
        """The last place that isn't after a token offset and doesn't divide a character."""
        w = bisect_right(self.tokens, token) - 1
        if self.tokens[w] == token or w == len(self.words):
            return self.tokens[w], self.chars[w]
        inner, chars = self._inside(w)
        k = bisect_right(inner, token - self.tokens[w]) - 1
        return self.tokens[w] + inner[k], self.chars[w] + chars[k]

    def cut(self, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
        """(start token, end token, start char, end char, kind of cut) of each piece."""
        if self.chars is None:
            self._prepare()
        total, out = self.tokens[-1], []
        overlap = max(0, min(overlap, limit - 1))
        start, start_char, done = 0, 0, 0
        while True:
            if total - start <= limit:
                out.append((start, total, start_char, self.chars[-1], "end"))
                return out
            least = max(done, start + overlap)  # a piece must reach beyond the last one, and beyond where the next begins
            k = bisect_right(self.strong_tokens, start + limit) - 1
            if k >= 0 and self.strong_tokens[k] > least:
                w, kind = self.strong[k], "sentence"
                if "\n" in self.words[w - 1] or "\r" in self.words[w - 1]:
                    kind = "line"
                end, end_char = self.tokens[w], self.chars[w]
            else:
                w, kind = bisect_right(self.tokens, start + limit) - 1, "word"
                end, end_char = self.tokens[w], self.chars[w]
                if end <= least:
                    (end, end_char), kind = self._at_or_before(start + limit), "hard"
                if end <= least:  # one character is larger than what the limit leaves beside the overlap
                    kind, w = "char", bisect_right(self.tokens, least) - 1
                    inner, chars = self._inside(w)
                    at = bisect_right(inner, least - self.tokens[w])
                    end, end_char = self.tokens[w] + inner[at], self.chars[w] + chars[at]
            out.append((start, end, start_char, end_char, kind))
            if end == total:
                return out
            done = end
            start, start_char = self._at_or_before(end - overlap) if overlap else (end, end_char)


def _pieces(limits: list[tuple[str, int, int]], folder: str):
    least = min(x for _, x, _ in limits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(folder)
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (n := splitter.load(text)) <= least:
                    continue
                for name, limit, overlap in limits:
                    if n > limit:
                        for k, piece in enumerate(splitter.cut(limit, overlap)):
                            for col, x in zip(cols, (name, doc, k, *piece)):
                                col.append(x)
            kinds = [pa.string(), pa.int64(), *[pa.int32()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["limit_name", "doc_id", "piece", "start_token", "end_token", "start_char", "end_char", "cut"])

    return run


def pieces(documents: DataFrame, limits: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str = tokens.TOKENIZERS) -> DataFrame:
    """The pieces of every text that is larger than a limit, for each limit.

    Offsets are half-open, of the text's own tokens and characters; ``substring(text, start_char + 1, end_char -
    start_char)`` is a piece. Pieces cover the text and share exactly the limit's overlap, or up to three tokens
    more where that would divide a character. Null, empty and small texts have no pieces; a limit that is null
    or below 1 is left out, a null overlap is none, one as large as the limit counts as the limit less one.
    Repeated texts are cut each for itself. Other columns play no part.
    """
    each = [(r.limit_name, r.max_tokens, r.overlap_tokens or 0) for r in limits.select("limit_name", "max_tokens", "overlap_tokens").where("max_tokens >= 1").orderBy("limit_name", "max_tokens").collect()]  # a parameter table
    if not each:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    own = spread(documents, id_col).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return own.mapInArrow(_pieces(each, folder), SCHEMA)


def with_text(documents: DataFrame, cut: DataFrame) -> DataFrame:
    """Pieces with their text; doc_id must be unique."""
    return cut.join(documents.select("doc_id", "text"), "doc_id").withColumn("piece_text", F.expr("substring(text, start_char + 1, end_char - start_char)")).drop("text")


def checks(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """Of each limit: pieces beyond it, pieces that leave a gap to the one before or the text's ends, pieces that share too little or too much with the one before, and whether just the larger texts are cut.

    Which texts are larger is told by encoding all of them.
    """
    spark = documents.sparkSession
    own = limits.select("limit_name", "max_tokens", F.least(F.greatest(F.coalesce("overlap_tokens", F.lit(0)), F.lit(0)), F.col("max_tokens") - 1).alias("overlap")).where("max_tokens >= 1")
    cut = materialize(pieces(documents, limits), "p9-pieces")
    sizes = materialize(encode.encode(documents).select("doc_id", F.size("ids").alias("n_tokens")).join(documents.select("doc_id", F.length("text").alias("n_chars")), "doc_id"), "p9-sizes")
    before = Window.partitionBy("limit_name", "doc_id").orderBy("piece")
    x = cut.withColumn("was", F.lag("end_token").over(before)).withColumn("was_char", F.lag("end_char").over(before)).withColumn("last", F.lead("piece").over(before).isNull())
    x = x.join(F.broadcast(own), "limit_name").join(sizes, "doc_id")
    shared = F.col("was") - F.col("start_token")
    gap = (F.col("start_char") > F.coalesce("was_char", F.lit(0))) | (F.col("start_token") > F.coalesce("was", F.lit(0))) | (F.col("last") & ((F.col("end_char") != F.col("n_chars")) | (F.col("end_token") != F.col("n_tokens"))))
    bad = x.groupBy("limit_name").agg(
        F.count_if(F.col("end_token") - F.col("start_token") > F.col("max_tokens")).alias("over"),
        F.count_if(gap).alias("gaps"),
        F.count_if((shared < F.col("overlap")) | (shared > F.col("overlap") + 3)).alias("other_overlap"),
        F.count_if(F.col("n_tokens") <= F.col("max_tokens")).alias("needless"),
        F.count_distinct("doc_id").alias("texts"),
    )
    each = [r.max_tokens for r in own.select("max_tokens").distinct().collect()]  # a parameter table
    larger = sizes.agg(*[F.count_if(F.col("n_tokens") > m).alias(str(m)) for m in each] or [F.count(F.lit(1))]).first().asDict()
    larger = spark.createDataFrame([(m, larger[str(m)]) for m in each], "max_tokens int, larger bigint")
    out = own.join(bad, "limit_name", "left").join(larger, "max_tokens").na.fill(0, ["over", "gaps", "other_overlap", "needless", "texts"])
    return out.select("limit_name", "over", "gaps", "other_overlap", ((F.col("needless") == 0) & (F.col("texts") == F.col("larger"))).alias("texts_match"))
