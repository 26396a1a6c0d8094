from __future__ import annotations

import pytest

from oracle import compare, connect
from stationlake import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    found = plans.QUERIES[name](spark, sf_dir)
    compare(found.collect(), found.columns, con.sql(plans.ORACLES[name]))


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_no_nested_loops_but_over_small_dimensions(spark, sf_dir):
    for name in ("asof_backward", "nearest_within_tol", "interval_overlap", "best_window", "point_in_polygon"):
        plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plans.QUERIES["sessions_users"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "o_totalprice" not in plan
