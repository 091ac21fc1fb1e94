"""Corpus rows, benchmark texts, byte and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.prefix import place_in_group, running_total
from quern.plans.runtime import spread


def source_name(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def corpus(documents: DataFrame) -> DataFrame:
    """(source, ordinal, doc_id, text) of the rows with text; the order within a source is (ordinal, doc_id)."""
    return spread(documents, "doc_id").select(source_name(F.col("source")).alias("source"), F.col("ordinal").cast("bigint").alias("ordinal"), "doc_id", "text").where(T.is_text(F.col("text")))


def identified(documents: DataFrame) -> DataFrame:
    """The corpus rows with document_id and split."""
    return corpus(documents).withColumn("document_id", T.document_id(F.col("text"))).withColumn("split", T.hash_split(F.col("document_id")))


def _word(c: Column, absent: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(absent))


def benchmark_text(task: str, row: dict[str, Column]) -> Column:
    """The text of a benchmark row by task. An absent column gives an empty string, a null in one that is there the word None."""
    # The columns of each task, in order.
    columns = {"hellaswag": ("ctx_a", "ctx_b", "activity_label", "endings"), "piqa": ("goal", "sol1", "sol2"), "winogrande": ("sentence", "option1", "option2"), "wikitext103": ("text",)}
    if task == "arc_easy":
        return F.concat(_word(row["question"], "None") if "question" in row else F.lit(""), F.lit(" "), F.coalesce(F.array_join(row["choices"]["text"], " ", "None"), F.lit("")) if "choices" in row else F.lit(""))
    if task not in columns:
        raise ValueError(f"no such benchmark task: {task}")
    return F.concat_ws(" ", *[_word(row[c], "None") if c in row else F.lit("") for c in columns[task]])


def python_list_text(items: Column) -> Column:
    """An array of strings as Python would print the list: quotes and brackets become tokens of their own."""
    def quoted(x: Column) -> Column:
        body = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
        plain = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), F.concat(F.lit('"'), body, F.lit('"'))).otherwise(plain)

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def byte_budget(rows: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Rows of each split, in order, until the split's bytes are reached: the row that crosses the budget is the last.

    ``rows`` has split, ordinal, doc_id and text. The scan as a whole ends where the last budget is met, but each split takes its own rows only.
    """
    own = rows.where(F.col("split").isin(*budgets)).withColumn("n_bytes", F.octet_length("text").cast("bigint")).select("split", "ordinal", "doc_id", "n_bytes")
    summed = running_total(own, "n_bytes", ["ordinal", "doc_id"], "bytes_before", by=["split"], label="byte-budget")
    limit = F.coalesce(*[F.when(F.col("split") == s, F.lit(n)) for s, n in budgets.items()])
    return summed.where(F.col("bytes_before") < limit)


def token_budget(rows: DataFrame, required: int, strict: bool = True) -> DataFrame:
    """Rows in order until their tokens, with one end-of-document id each, reach ``required`` + 1.

    ``rows`` has ordinal, doc_id and n_tokens. If they never do, that is an error when ``strict``.
    """
    own = rows.select("ordinal", "doc_id", (F.col("n_tokens") + 1).cast("bigint").alias("stored"))
    summed = running_total(own, "stored", ["ordinal", "doc_id"], "stored_before", label="token-budget")
    if strict and (own.agg(F.sum("stored")).first()[0] or 0) < required + 1:
        raise RuntimeError("the source ended before the token budget was met")
    return summed.where(F.col("stored_before") < required + 1)


def capped_tokens(rows: DataFrame, required: int, context: int = 512) -> DataFrame:
    """Stored ids of each row of the budget that remain after trimming to whole windows and one id; no error if short."""
    most = required // context * context + 1
    return token_budget(rows, required, strict=False).withColumn("kept", F.least(F.col("stored"), F.lit(most) - F.col("stored_before"))).where("kept > 0")


def validation_budget(rows: DataFrame, required: int) -> DataFrame:
    """The validation rows that reach ``required`` + 1 stored ids, and the train rows seen until then.

    ``rows`` has split, ordinal, doc_id and n_tokens. If validation ends before, that is an error.
    """
    own = token_budget(rows.where("split = 'validation'"), required)
    last = own.agg(F.max(F.struct("ordinal", "doc_id")).alias("last")).first().last
    if last is None:
        return rows.limit(0).select("split", "ordinal", "doc_id")
    seen = F.struct(F.col("ordinal").cast("bigint").alias("o"), F.col("doc_id").cast("bigint").alias("d")) <= F.struct(F.lit(last.ordinal).cast("bigint").alias("o"), F.lit(last.doc_id).cast("bigint").alias("d"))
    return rows.where(F.col("split").isin("train", "validation") & seen).select("split", "ordinal", "doc_id")


def unique_names(rows: DataFrame, name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """``rows`` with a name of their own: the second of a name, in order, has ``.1`` behind it, the next ``.2``. A null stays null."""
    placed = place_in_group(rows, [name], order, "_nth", label="names")
    return placed.withColumn(out, F.when(F.col("_nth") > 0, F.concat(name, F.lit("."), F.col("_nth").cast("string"))).otherwise(F.col(name))).drop("_nth")
