"""Every core query with SQL runs in both engines over the small tables and gives the same rows."""

import math
import os

import duckdb
import pytest

from timberline.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fix = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else x + 0.0 if isinstance(x, float) else x
    return sorted(cols), sorted((tuple(fix(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(SQL[name])
    assert got == plain(cur.fetchall(), [c[0] for c in cur.description])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["query_id", "candidate_id", "similarity"]
