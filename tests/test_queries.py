"""Every query of the core library against DuckDB at sf0.001, and rows for those without SQL."""

import os

import duckdb
import pytest

from gradeworks.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    try:
        return f"{float(v):.5f}".replace("-0.00000", "0.00000")
    except TypeError:
        return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted([cell(r[c]) for c in columns] for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows == sorted([cell(r[want.columns.index(c)]) for c in columns] for r in want.fetchall())
