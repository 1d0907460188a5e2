import pytest

import __spark_entry__ as driver
from palimpsest.plans import catalog
from tests.oracle import both


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    mine, theirs = both(spark, catalog.QUERIES[name], catalog.ORACLES[name])
    assert mine == theirs


def test_entry(spark):
    assert driver.entry(spark).columns == ["k", "seq", "op", "v"]
    assert set(catalog.QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_key_filter_reaches_the_scan(spark):
    plan = catalog.QUERIES["kv_scan_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(user_id,20)" in plan and "LessThan(user_id,60)" in plan


def plan_of(spark, df):
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["gc_base_level", "gc_retain", "gc_drop_counts", "rel_lookup_join", "kv_latest_state"])
def test_plans_have_no_nested_loop_and_no_window(spark, name):
    plan = plan_of(spark, catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and (name == "gc_base_level" or "Window" not in plan)
