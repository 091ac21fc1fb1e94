"""Every query runs over the smallest tables, and those with SQL give its rows."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quern.llm import oracle, queries
from tests.conftest import SF


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    assert rows or name == "p1_report"
    if sql := oracle.oracle_sql().get(name):
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        cur = con.execute(sql)
        at = [c[0] for c in cur.description]
        assert sorted(at) == sorted(df.columns)
        assert Counter(tuple(r[c] for c in at) for r in rows) == Counter(cur.fetchall())
