"""Problem 2: a reproducible sample that stays stable as data grows.

Golden-ratio low-discrepancy selection. Every record key gets a sequence number that it keeps for good: keys
are numbered within their split in the order of the delivery that first brought them and, within a delivery,
of a seeded hash. Number i is mapped to the fractional part of (shift + i * golden ratio), and is selected if
that lies in [0, rate). New deliveries only append numbers, so nothing selected is ever dropped, and any run
of numbers is covered evenly.

Numbers persist in an append-only table (``extend``): only keys it lacks are numbered, behind all others, whatever
delivery number they carry or lack. Without a table the deliveries are replayed from ``ingest_batch``, which gives the same
numbers as long as no delivery is added to later; rows without a delivery then have no place in the order and are
numbered apart, by their own hash, so that nothing that comes later can move them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans.runtime import materialize, shared_dir

#: 2^31 over the golden ratio, rounded to odd: fractional multiples in whole numbers of 31 bits.
GOLDEN_31 = 1327217885
BITS_31 = 1 << 31
#: The fixed random shift, and the seed of the order within a delivery.
SHIFT, SEED = 715827883, "quern-sample-1"
RATE = 0.1
#: Keys ranked together, about; bounds a window's group whatever the size of the table.
GROUP_KEYS = 50_000
MOST_GROUP_BITS = 20
#: The delivery of rows that name none, and where the numbers of such keys begin.
NO_BATCH, APART = 2147483647, 1 << 62


def record_key(document_id: Column, split: Column, doc_id: Column) -> tuple[Column, Column]:
    """(key, split): the id's 64 hex digits, else the id as it is, else the row's own number; the split without case and blanks."""
    bare = F.lower(F.regexp_replace(document_id, r"(?U)^\s+|\s+$", ""))
    bare = F.regexp_replace(bare, r"^sha256:\s*", "")
    return F.coalesce(bare, F.concat(F.lit("row:"), doc_id.cast("string"))), F.coalesce(F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", "")), F.lit(""))


def _keys(documents: DataFrame) -> DataFrame:
    """(document_id, split, first_batch, records, h) of each record key."""
    key, split = record_key(F.col("document_id"), F.col("split"), F.col("doc_id"))
    own = documents.select(key.alias("document_id"), split.alias("split"), F.coalesce(F.col("ingest_batch").cast("int"), F.lit(NO_BATCH)).alias("batch")).where("document_id is not null")
    keys = own.groupBy("document_id", "split").agg(F.min("batch").alias("first_batch"), F.count(F.lit(1)).alias("records"))
    return keys.withColumn("h", F.sha2(F.concat_ws("\x1f", F.lit(SEED), "split", "document_id"), 256))


def _numbered(keys: DataFrame, about: int, first: DataFrame | None = None) -> DataFrame:
    """``keys`` with seq: in each split in the order (first_batch, h), from 0 or behind ``first`` (split, n)."""
    # the number of groups changes with the table, the order doesn't: a group is a stretch of the hash order
    bits = min(MOST_GROUP_BITS, max(0, (max(1, about) // GROUP_KEYS).bit_length()))
    keys = keys.withColumn("grp", F.shiftright(F.conv(F.substring("h", 1, 5), 16, 10).cast("int"), 20 - bits))
    order = ["split", "first_batch", "grp"]
    sizes = keys.groupBy(*order).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("split").orderBy("first_batch", "grp").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*order, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    if first is not None:
        starts = starts.join(F.broadcast(first), "split", "left").withColumn("start", F.col("start") + F.coalesce("n", F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(*order).orderBy("h", "document_id"))
    return keys.withColumn("within", within).join(starts, order).select("document_id", "split", "first_batch", "records", (F.col("start") + F.col("within") - 1).alias("seq"))


def sequence(documents: DataFrame) -> DataFrame:
    """(document_id, split, first_batch, records, seq) of each record key.

    Records are the same key if id and split are, whatever their notation; a null split is a split of its own, and a
    null id makes each row its own record. A key with no ingest_batch at all has a number from its hash, far behind those
    of the deliveries. Rows with neither id nor doc_id are no records. An empty table gives no rows; other columns play no part.
    """
    keys = _keys(documents)
    apart = F.lit(APART) + F.conv(F.substring("h", 1, 13), 16, 10).cast("bigint")
    lacking = keys.where(F.col("first_batch") == NO_BATCH).select("document_id", "split", "first_batch", "records", apart.alias("seq"))
    return _numbered(keys.where(F.col("first_batch") != NO_BATCH), documents.count()).unionByName(lacking)


_TABLE = "document_id string, split string, first_batch int, seq bigint"


def table(spark: SparkSession, path: str) -> DataFrame:
    """The numbers given so far; none if there is no table yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(_TABLE).parquet(path) if there else spark.createDataFrame([], _TABLE)


def extend(delivery: DataFrame, path: str) -> DataFrame:
    """Number the record keys that the table at ``path`` lacks, append them, and return the whole table.

    The table is on shared storage and has one writer at a time. A delivery that comes again, whole or in part, late rows
    of an earlier one, and rows without a delivery number change no number that was given.
    """
    spark = delivery.sparkSession
    known = table(spark, path)
    first = known.groupBy("split").agg((F.max("seq") + 1).alias("n"))  # a row for each split
    new = _keys(delivery).join(known.select("document_id", "split"), ["document_id", "split"], "left_anti")
    _numbered(new, delivery.count(), first).select("document_id", "split", "first_batch", "seq").write.mode("append").parquet(path)
    return table(spark, path)


def fraction(seq: Column) -> Column:
    """shift + seq * golden ratio, modulo 1, in units of 2^-31."""
    return F.pmod(F.pmod(seq, F.lit(BITS_31)) * F.lit(GOLDEN_31) + F.lit(SHIFT), F.lit(BITS_31))


def selected(numbered: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of a table of numbers that are in the sample."""
    return numbered.where(fraction(F.col("seq")) < F.lit(round(rate * BITS_31)))


def sample(documents: DataFrame, rate: float = RATE) -> DataFrame:
    """The selected record keys."""
    return selected(sequence(documents), rate)


def growth(documents: DataFrame) -> DataFrame:
    """For each split and delivery k: record keys there are after k, those selected, and their share."""
    numbered = sequence(documents).withColumn("chosen", (fraction(F.col("seq")) < F.lit(round(RATE * BITS_31))).cast("int"))
    each = numbered.groupBy("split", "first_batch").agg(F.count(F.lit(1)).alias("new_keys"), F.sum("chosen").alias("new_selected"))
    upto = Window.partitionBy("split").orderBy("first_batch")
    return each.select("split", "first_batch", "new_keys", "new_selected", F.sum("new_keys").over(upto).alias("keys"), F.sum("new_selected").over(upto).alias("selected"))


def stability(documents: DataFrame) -> DataFrame:
    """For each delivery, numbered into a table of its own one after another: keys, selected keys, and those selected before that are no longer.

    Of each delivery every seventh document comes late, with the next; the last one's with a delivery of its own, of no number.
    """
    spark = documents.sparkSession
    path = f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}-p2-numbers-{uuid.uuid4().hex}"
    late = F.coalesce(F.col("doc_id") % 7 == 0, F.lit(False)).cast("int")
    own = documents.select("document_id", "split", "doc_id", "ingest_batch", (F.coalesce(F.col("ingest_batch"), F.lit(0)) + late).alias("comes"))
    out, before = [], spark.createDataFrame([], "document_id string, split string")
    for k in [r.comes for r in own.select("comes").distinct().orderBy("comes").collect()]:  # a few
        numbers = materialize(extend(own.where(F.col("comes") == k), path), "p2-state")  # the table itself goes on growing
        chosen = selected(numbers).select("document_id", "split")
        out.append((k, numbers.count(), chosen.count(), before.join(chosen, ["document_id", "split"], "left_anti").count()))
        before = chosen
    return spark.createDataFrame(out, "delivery int, keys bigint, selected bigint, lost bigint")
