"""Problem 4: evaluation texts leaking into documents.

Each map task gathers its documents into shards of bounded size and builds an FM-index over the words of
each. All test phrases, runs of 13 words of the items, are backward-searched at once through wavelet-matrix
ranks; occurrences are located by sampled suffix positions and their spans merged. Documents are never shuffled: the
items, a stated query set, go to them in blocks of bounded size, and only hits are brought together. Words that no item
of the block has can be in no match and stand in the index as separators.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.fmindex import FMIndex
from quern.llm.words import word_spans, words
from quern.plans.runtime import materialize, spread

#: Characters of item text in one block, hence the bound of what is broadcast at once: for each word four bytes, and
#: sixteen more where a phrase begins, besides the distinct words.
BLOCK_CHARS = 4_000_000
#: Words of a shard. A document is never cut, so a longer one makes a larger shard.
SHARD_WORDS = 1 << 20
#: Most hit documents that are broadcast when spans are removed; more are joined by shuffle.
BROADCAST_HITS = 200_000


class Phrases:
    """The phrases of a block of items: where each distinct one begins in their words, and the items that have it."""

    def __init__(self, items: Iterable[tuple[int, str]], width: int) -> None:
        self.width, self.ids = width, {}
        self.flat, starts, owners = array("i"), array("i"), array("q")
        for item, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            n = max(0, len(own) - width + 1)
            starts.extend(range(len(self.flat), len(self.flat) + n))
            owners.extend([item] * n)
            if n:
                self.flat.extend(own)
        self.flat = np.array(self.flat, np.int32)
        starts, owners = np.array(starts, np.int64), np.array(owners, np.int64)
        runs = np.lib.stride_tricks.sliding_window_view(self.flat, width)[starts] if len(starts) else np.zeros((0, width), np.int32)
        _, first, which = np.unique(runs, axis=0, return_index=True, return_inverse=True)
        self.starts = starts[first]
        both = np.unique(np.stack([which.ravel().astype(np.int64), owners], 1), axis=0)
        self.owners, self.owner_at = both[:, 1], np.searchsorted(both[:, 0], np.arange(len(first) + 1))

    def owners_of(self, phrases: np.ndarray) -> set[int]:
        return {x for p in np.unique(phrases).tolist() for x in self.owners[self.owner_at[p] : self.owner_at[p + 1]].tolist()}


class _Shard:
    def __init__(self) -> None:
        self.symbols, self.runs, self.docs, self.offsets = array("i"), array("q"), array("q"), array("q")
        self.texts: list[tuple[int, str]] = []

    def add(self, doc: int, text: str, symbols: list[int], width: int) -> None:
        """Keep the runs of at least ``width`` words of the phrases' vocabulary, and the text of a document that has any."""
        s = np.array(symbols, np.int32)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], s != 0, [0]])))
        had = len(self.runs)
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= width:
                self.runs.append(len(self.symbols)), self.docs.append(len(self.texts)), self.offsets.append(a)
                self.symbols.extend(symbols[a:b])
                self.symbols.append(0)
        if len(self.runs) > had:
            self.texts.append((doc, text))

    def hits(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in texts, word offset, phrase) of each occurrence."""
        if not self.symbols:
            return (np.zeros(0, np.int64),) * 3
        index = FMIndex(np.array(self.symbols, np.int32), len(phrases.ids))
        low, high = index.search_at(phrases.flat, phrases.starts, phrases.width)
        n = high - low
        phrase = np.repeat(np.arange(len(n)), n)
        places = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
        at = index.locate(places)
        runs = np.array(self.runs)
        run = np.searchsorted(runs, at, side="right") - 1
        return np.array(self.docs)[run], np.array(self.offsets)[run] + at - runs[run], phrase


def _merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_HITS = "doc_id bigint, items array<bigint>, spans array<struct<start:int,end:int>>, chars array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", _SPANS), ("chars", _SPANS)])


def _hit(doc: int, items: Iterable[int], spans: list[tuple[int, int]], chars: Iterable[tuple[int, int]]) -> dict:
    return {"doc_id": doc, "items": sorted(items), "spans": [{"start": a, "end": b} for a, b in spans], "chars": [{"start": a, "end": b} for a, b in _merge(chars)]}


def _leaks(shared, shard_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        get, width = phrases.ids.get, phrases.width
        shard, held = _Shard(), 0

        def out(shard: _Shard) -> pa.RecordBatch:
            at, offset, phrase = shard.hits(phrases)
            order = np.lexsort((offset, at))
            at, offset, phrase = at[order], offset[order], phrase[order]
            rows = []
            for k in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(at) else []:
                doc, text = shard.texts[at[k[0]]]
                spans = _merge((a, a + width) for a in offset[k].tolist())
                starts, ends = word_spans(text)
                rows.append(_hit(doc, phrases.owners_of(phrase[k]), spans, [(starts[a], ends[b - 1]) for a, b in spans]))
            return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                symbols = [get(w, 0) for w in words(t)]
                if len(symbols) >= width:
                    shard.add(d, t, symbols, width)
                    held += len(symbols)
                    if held >= shard_words:
                        yield out(shard)
                        shard, held = _Shard(), 0
        yield out(shard)

    return run


def _united(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of a document's hits made one."""
    for b in batches:
        rows = [_hit(x["doc_id"], set().union(*x["items"]), _merge((s["start"], s["end"]) for y in x["spans"] for s in y), ((s["start"], s["end"]) for y in x["chars"] for s in y)) for x in b.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def leaks(documents: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, block_chars: int = BLOCK_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for each document with a common run of ``width`` words: doc_id, the items, and the merged spans to remove, in words and in characters of the text itself.

    Null or empty texts and items or texts of fewer words are never cases; rows with a null id neither. Items
    that repeat each other are all named. A doc_id that occurs more than once has one row, with the spans of all. Without
    an item or a document there is no row. Other columns play no part, nor do the sizes of blocks and shards.
    """
    spark = documents.sparkSession
    own = spread(documents, id_col).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    wanted = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    blocks = max(1, -(-(wanted.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    out = None
    for k in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toLocalIterator()
        phrases = Phrases(((r.item_id, r.text) for r in rows), width)
        if len(phrases.starts):
            part = own.mapInArrow(_leaks(spark.sparkContext.broadcast(phrases), shard_words), _HITS)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], _HITS)
    each = out.groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in ("items", "spans", "chars")])
    return each.mapInArrow(_united, _HITS)


def found(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each document and leaked item."""
    return leaks(documents, items, **options).select("doc_id", F.explode("items").alias("item_id"))


def by_item(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(item_id, documents) of each item that leaked."""
    return found(documents, items, **options).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def word_spans_of(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, first, last) of each merged span, in words."""
    return leaks(documents, items, **options).select("doc_id", F.explode("spans").alias("x")).select("doc_id", F.col("x.start").alias("first"), (F.col("x.end") - 1).alias("last"))


def _without(text: str, spans: str) -> Column:
    """The text without the characters of the spans, which are in order."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x.end))
    starts = F.concat(F.transform(spans, lambda x: x.start), F.array(F.length(text)))
    return F.array_join(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substring(F.col(text), x.a + 1, x.b - x.a)), "")


def removed(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, text, removed) of every document: its text without the leaked passages, and how many characters they had.

    A null text stays null. doc_id must be unique. What stood before and behind a passage comes together.
    """
    hits = materialize(leaks(documents, items, **options).select("doc_id", "chars"), "p4-hits")
    few = hits.count() <= BROADCAST_HITS
    own = documents.select("doc_id", "text").join(F.broadcast(hits) if few else hits, "doc_id", "left")
    own = own.withColumn("chars", F.coalesce("chars", F.array().cast("array<struct<start:int,end:int>>")))
    removed = F.aggregate("chars", F.lit(0), lambda n, x: n + x.end - x.start)
    return own.select("doc_id", F.when(F.size("chars") > 0, _without("text", "chars")).otherwise(F.col("text")).alias("text"), F.when(F.col("text").isNotNull(), removed).alias("removed"))
