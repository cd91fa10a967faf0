"""Every query of the engine proper against its SQL; those that SQL can't express must run and give rows."""

import pytest

import __spark_entry__
from strataspan.plans import catalog


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_same_as_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_gives_rows(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["user_id", "start_us", "len_us"]


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_cartesian_product_and_pruned_scan(spark, sf):
    plan = catalog.QUERIES["overlap_per_window"](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan.split("== Physical Plan ==")[-1].replace("BroadcastNestedLoopJoin BuildRight, Inner", "", 2)
    plan = catalog.QUERIES["latest_valid"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_orderpriority" not in plan
