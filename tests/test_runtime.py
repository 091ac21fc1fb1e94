import pytest
from pyspark.sql import functions as F

from quern.plans import runtime as R


def test_materialized_tables_are_read_back_and_dropped(spark):
    df = spark.range(10).withColumn("x", F.when(F.col("id") > 4, F.array(F.lit("a"))))
    back = R.materialize(df, "test")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert back.dtypes == df.dtypes and R.materialize(df.limit(0), "test").isEmpty()
    R.drop_materialized(spark)
    R.drop_materialized(spark)
    with pytest.raises(Exception):
        back.count()


def test_bucketed_tables_join_without_a_shuffle(spark):
    df = spark.range(2000).select(F.sha2((F.col("id") % 700).cast("string"), 256).cast("binary").alias("k"), "id")
    back = R.materialize_bucketed(df.repartition(5, "k"), "test", 5, "k")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    joined = back.join(back.groupBy("k").agg(F.min("id").alias("first")).hint("merge"), "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and joined.where("id > first").count() == 1300
    assert R.materialize_bucketed(df.limit(0).repartition(5, "k"), "test", 5, "k").isEmpty()
    R.drop_materialized(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quern_")]


def test_spread_keeps_every_row(spark):
    df = spark.range(100).withColumn("k", F.when(F.col("id") % 3 == 0, F.col("id")))
    assert sorted(r.id for r in R.spread(df, "k").collect()) == list(range(100))


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    assert R.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    monkeypatch.setattr(R, "is_local", lambda s: False)

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    with pytest.raises(RuntimeError):
        R.shared_dir(Session())
