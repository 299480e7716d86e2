"""Every query of the engine against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from evidentia.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, tables, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    mine = [tuple(plain(x) for x in r) for r in got.select(*columns).collect()]
    want = tables.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in order) for r in want.fetchall()]
    assert sorted(mine, key=str) == sorted(theirs, key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).limit(5).count() == 5
