"""Every registered query that has SQL gives the same rows in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name[:-8]} as select * from read_parquet('{SMALL}/{name}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    return value


def rows_of(columns, rows):
    return sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    expected = [dict(zip(names, row)) for row in cursor.fetchall()]
    assert rows_of(columns, [r.asDict() for r in df.collect()]) == rows_of(columns, expected)


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_flagship(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and all(r["threat_level"] in ("Low", "Medium", "High") for r in rows)
    assert all(r["severity"] for r in rows)
