"""Every query with a SQL counterpart gives the same rows (smallest tables)."""

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_as_sql(spark, con, name):
    verdict, _, note = compare(spark, con, SF, name, contract.queries()[name], contract.oracle_sql()[name])
    assert verdict == "ok", note


def test_catalogue_is_consistent(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 1
