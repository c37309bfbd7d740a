"""Plan checks over every registered driver binding (smoke data)."""

import pytest

import __spark_entry__ as entry
from commsight.plans import fixtures

SMOKE = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(fixtures.QUERIES))
def test_no_cartesian_products(spark, name):
    plan = _plan(entry.queries()[name](spark, SMOKE))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_an_oracle():
    assert set(fixtures.QUERIES) - set(entry.oracle_sql()) == set()


def test_partial_aggregation_before_shuffle(spark):
    for name in ("dedup_keep_first", "status_counts", "providers_by_country"):
        plan = _plan(entry.queries()[name](spark, SMOKE))
        assert "partial_" in plan, name


def test_filters_reach_the_scan(spark):
    plan = _plan(entry.queries()["filter_in"](spark, SMOKE))
    assert "PushedFilters: [In(n_name, [ATLANTIS,NATION_1,NATION_7])]" in plan
    plan = _plan(entry.queries()["status_counts"](spark, SMOKE))
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "Country", "kind", "provider"]
    assert df.count() > 0
