"""Plan checks: every catalog query runs without Cartesian products or Python UDFs,
and its scans read only the columns they need."""

import pytest

from expkit.plans.catalog import QUERIES

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_no_python(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for b in BAD:
        assert b not in plan, f"{name}: {b} in plan"


def test_scan_prunes_columns_and_pushes_filters(spark, sf_dir):
    df = QUERIES["combined_txns"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan
    # lineitem has 11 columns; the builder reads only the ones it needs.
    assert "l_comment" not in plan and "l_shipdate" not in plan
