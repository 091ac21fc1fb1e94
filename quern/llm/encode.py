"""Problem 7: encoding of the whole corpus.

Distinct-word table: texts are split into pre-token words in Spark, the words counted, and each distinct
word of a table of the most frequent ones, of bounded size, is encoded once, where its hash partition lies; the table is
broadcast and each text's ids are put together by the position of its words. Words beyond the bound are rare,
and are encoded where they stand. Decoding joins ids to their pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import tokens
from quern.plans.runtime import materialize, spread

#: Most words in the broadcast table; with words of at most tokens.WORD_CHARS characters this bounds its bytes.
TABLE_WORDS = 100_000
#: Entries of a task's word counter before it hands them on.
COUNTER_WORDS = 500_000


def _count_words(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = tokens.encoder(folder).split, Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in held.items() if len(w) <= tokens.WORD_CHARS]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                held.update(split(text))
            if len(held) >= COUNTER_WORDS:
                yield out()
                held.clear()
        yield out()

    return run


def _encode_words(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(folder).encode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(encode(w), np.int32).tobytes() for w in b.column(0).to_pylist()], pa.binary())], names=["word", "ids"])

    return run


def word_table(texts: DataFrame, folder: str = tokens.TOKENIZERS, most: int = TABLE_WORDS) -> DataFrame:
    """(word, ids as packed int32) of at most ``most`` words that occur more than once in the column ``text``: all of at least some count.

    The least count is read off how many words have each, by sixteenths of a power of two; nothing is sorted, and each
    word is encoded where it was counted.
    """
    counted = texts.select("text").where("text is not null").mapInArrow(_count_words(folder), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = materialize(counted.withColumn("step", F.floor(F.log2("n") * 16).cast("int")), "p7-words")
    least, total = None, 0
    for step, n in sorted(((r.step, r.n) for r in counted.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):  # at most 16 * 63 rows
        total += n
        if total > most:
            break
        least = step
    if least is None:
        return texts.sparkSession.createDataFrame([], "word string, ids binary")
    return counted.where(F.col("step") >= least).select("word").mapInArrow(_encode_words(folder), "word string, ids binary")


def _encode_texts(shared, folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(folder)
        get, split = tokens.WordIds(encoder, shared.value).__getitem__, encoder.split
        for b in batches:
            packed = [b"".join(map(get, split(t))) if t else b"" for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return run


def encode(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str = tokens.TOKENIZERS, table_words: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, ids) of every row. Empty and null texts have the empty list; no special token is added.

    Rows that repeat each other, and rows with a null id, each keep their row. Other columns play no part.
    """
    own = spread(documents, id_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = {r.word: bytes(r.ids) for r in word_table(own, folder, table_words).collect()}  # at most table_words rows
    shared = documents.sparkSession.sparkContext.broadcast(table)
    return own.mapInArrow(_encode_texts(shared, folder), T.StructType([*own.select("doc_id").schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def piece_table(spark, folder: str = tokens.TOKENIZERS) -> DataFrame:
    return spark.createDataFrame([(i, bytearray(p)) for p, i in tokens.pieces(folder).items()], "id int, piece binary")


def decode(encoded: DataFrame, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes): the UTF-8 bytes of the text, by a join of ids to the fixed table of pieces.

    Rows are told apart by doc_id, which must be unique. A null or empty list gives empty bytes; an id the
    vocabulary lacks gives null.
    """
    spark = encoded.sparkSession
    at = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    joined = at.join(F.broadcast(piece_table(spark, folder)), "id", "left")
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("x")))), lambda r: r.x), "")
    return joined.groupBy("doc_id").agg(F.when(F.count_if(F.col("id").isNotNull() & F.col("piece").isNull()) == 0, F.unhex(digits)).alias("bytes"))


def round_trip(documents: DataFrame) -> DataFrame:
    """(doc_id, n_ids, same) of every document: whether decoding its ids gives its text again."""
    encoded = materialize(encode(documents), "p7-ids")
    back = decode(encoded)
    sizes = encoded.select("doc_id", F.size("ids").alias("n_ids"))
    return documents.select("doc_id", "text").join(sizes, "doc_id").join(back, "doc_id").select("doc_id", "n_ids", (F.encode(F.coalesce("text", F.lit("")), "UTF-8") == F.col("bytes")).alias("same"))


def decoded(documents: DataFrame) -> DataFrame:
    """(doc_id, digest) of every document: SHA-256 of what its ids decode to."""
    return decode(encode(documents)).select("doc_id", F.sha2("bytes", 256).alias("digest"))
