"""Corpus queries against their check SQL on the given tables."""

import duckdb
import pytest

from check import compare
from groundcover.llm.queries import ORACLES, QUERIES
from groundcover.plans.views import ALL_TABLES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ALL_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches(spark, sf, con, name):
    result = compare(QUERIES[name](spark, sf), con, ORACLES[name])
    assert result.startswith("ok"), result
    assert "types" not in result, result


@pytest.mark.parametrize("name", ["op1_license_scan", "op6_quality_rules", "op8_mix_sources", "op9_chat_format",
                                  "op10_shard_tree"])
def test_no_user_functions(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
