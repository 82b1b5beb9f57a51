"""Every training-data query runs over the small tables; columns are those stated; SQL gives the same rows."""

import os

import duckdb
import pytest

from timberline.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()
COLUMNS = {
    "p1_found": [("result_id", "bigint"), ("shot", "string"), ("defect", "string")],
    "p2_found": [("vector_name", "string"), ("profile_id_a", "bigint"), ("profile_id_b", "bigint")],
    "p3_found": [("spelling_a", "string"), ("spelling_b", "string")],
    "p5_found": [("field", "string"), ("row_id", "bigint")],
    "p7_found": [("field", "string"), ("row_id", "bigint"), ("kind", "string"), ("start_at", "int")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p10_found": [("doc_id", "bigint"), ("kind", "string"), ("seg_no", "int"), ("lang", "string")],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    n = df.count()
    assert n > 0 or name == "p2_found"
    if name.endswith("_found"):
        assert df.distinct().count() == n


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, medium, name):
    con = duckdb.connect()
    for f in os.listdir(medium):
        con.execute(f"create view {f[:-8]} as select * from '{medium}/{f}'")
    df = QUERIES[name](spark, medium)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(SQL[name]).fetchall())
