"""The operators that SQL can express, against DuckDB at sf0.001."""

import os

import duckdb
import pytest

from gradeworks.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_those_of_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert rows and sorted(rows, key=str) == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=str)
