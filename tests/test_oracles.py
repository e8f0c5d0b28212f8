"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, compare

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, duck, data):
    line, fine = compare(name, spark, duck, data, QUERIES[name], ORACLES[name])
    assert fine, line


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    frame = contract.entry(spark)
    assert len(frame.columns) == 45 and frame.count() > 0
