"""Every core query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from corpusloom.catalog import ORACLE_SQL, QUERIES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, data, con, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(ORACLE_SQL[name]).columns)
    theirs = con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(repr(plain(tuple(r))) for r in df.select(*columns).collect()) == sorted(repr(plain(r)) for r in theirs)


def test_all_queries_run(spark, data):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
