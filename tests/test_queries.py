"""Every core query over the smallest tables gives the rows of its SQL."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quern.plans import oracle, queries
from tests.conftest import SF


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, sql, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    if name not in oracle.oracle_sql():
        assert rows
        return
    cur = sql.execute(oracle.oracle_sql()[name])
    at = [c[0] for c in cur.description]
    assert sorted(at) == sorted(df.columns)
    assert Counter(tuple(plain(r[c]) for c in at) for r in rows) == Counter(tuple(map(plain, r)) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
