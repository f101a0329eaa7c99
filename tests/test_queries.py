"""Every registered query against DuckDB on the smallest driver data."""

import duckdb
import pytest

import __spark_entry__ as driver
from checks.compare import compare, register_tables

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    register_tables(connection, SF)
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name in ORACLES:
        assert compare(got, con, ORACLES[name]) is None
    else:
        assert got.num_rows > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert 0 < driver.entry(spark).count() <= 10
