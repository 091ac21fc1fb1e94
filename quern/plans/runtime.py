"""Session helpers shared by all operators: table access, shared storage, package shipping."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()
_LOCAL_SHARED: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder; each is one Parquet file or folder named ``<table>.parquet``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drop_materialized(spark: SparkSession) -> None:
    """Delete what this session's operators have written to the shared folder. Results not yet read are lost with it."""
    jvm, path = spark.sparkContext._jvm, f"{shared_dir(spark)}/quern"
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    app = spark.sparkContext.applicationId
    for status in files.listStatus(target) if files.exists(target) else []:
        if status.getPath().getName().startswith(f"{app}-"):
            files.delete(status.getPath(), True)
    for t in spark.catalog.listTables(pattern=f"{_tables(spark)}*"):
        spark.sql(f"DROP TABLE IF EXISTS {t.name}")


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a single-JVM session, as in tests, may go without the setting; it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_SHARED:
            _LOCAL_SHARED[app] = tempfile.mkdtemp(prefix="quern-shared-")
            atexit.register(shutil.rmtree, _LOCAL_SHARED[app], True)
        found = _LOCAL_SHARED[app]
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there.

    Unlike executor-local caching the written table outlives the loss of any executor, and unlike
    ``checkpoint()`` it computes ``df`` once and can be read by column.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_all(spark: SparkSession, parts: Iterable[DataFrame], schema: str, label: str) -> DataFrame:
    """As ``materialize`` for rows that are made in several runs: each of ``parts`` is written before the next is asked for."""
    path = f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}-{label}-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _tables(spark: SparkSession) -> str:
    """How the names of this session's bucketed tables begin."""
    return "quern_" + re.sub(r"\W", "_", spark.sparkContext.applicationId) + "_"


def materialize_bucketed(df: DataFrame, label: str, buckets: int, key: str) -> DataFrame:
    """As ``materialize``, in files by a hash of ``key``: joins and groups by it need no further shuffle.

    ``df`` should come from ``repartition(buckets, key)``, so that each task writes one file.
    """
    spark = df.sparkSession
    name = f"{_tables(spark)}{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}-{label}-{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


#: Input bytes a core should have before a small table is spread over all cores.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of few, small row groups over all cores, by a hash of ``key``; a larger one as it is read.

    A file's row group is read by one task however many cores there are. What is moved is below ``SPREAD_BYTES`` a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size < SPREAD_BYTES * cores else df


def ship_package(spark: SparkSession) -> None:
    """Give executors on other machines this package, so that Python operators can import it."""
    app = spark.sparkContext.applicationId
    if is_local(spark) or app in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="quern-ship-"), "quern_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, Path(PACKAGE.name) / p.relative_to(PACKAGE))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
