"""Plan shape: no Cartesian products, nested-loop joins or Python evaluation; partial
aggregation before the shuffle; partition pruning on the period."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.mark.parametrize("name", ["report_by_group", "compare_periods", "compare_years", "new_and_removed_facilities",
                                  "status_pivot", "hierarchy_index", "radius_join", "dedup_keep_first",
                                  "search_global", "leader_per_measure", "geo_grid_cells", "measure_summary"])
def test_plan_shape(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in FORBIDDEN if f in plan]
    if "HashAggregate" in plan:
        assert "partial_" in plan or "HashAggregate(keys=[" in plan


@pytest.mark.parametrize("name", ["compare_periods", "latest_period_filter"])
def test_period_pruning(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "period_key" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
