"""Every registered query against its check SQL; queries without one must run and give columns."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare
from groundcover.plans import all_queries
from groundcover.plans.views import ALL_TABLES

QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ALL_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_check_sql(spark, sf, con, name):
    result = compare(QUERIES[name](spark, sf), con, ORACLES[name])
    assert result.startswith("ok"), result
    assert "types" not in result, result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
