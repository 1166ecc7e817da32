"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, other, name):
    df = contract.queries()[name](spark, FOLDER)
    rows = df.collect()
    if name in ORACLES:
        result = other.execute(ORACLES[name])
        columns = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows_of(df.columns, rows) == rows_of(columns, result.fetchall())


def test_every_check_has_its_query():
    assert set(ORACLES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
