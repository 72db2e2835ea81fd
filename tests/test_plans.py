"""Plan regressions: no registered query may plan a cross product / nested-loop join, the
flagship's final plan stays small, and scans read only the needed columns."""
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FAST = sorted(set(E.oracle_sql()) - {"stream_hourly_sum"})


def _plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", FAST)
def test_no_cross_products(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_flagship_final_plan_is_small(spark):
    plan = _plan(spark, "prep_rainfall")
    assert len(re.findall(r"\bExchange (hashpartitioning|rangepartitioning|SinglePartition)", plan)) <= 3
    assert "FileScan parquet" not in plan  # the final stage reads checkpoints, not the raw feed again


def test_scans_are_pruned(spark):
    plan = _plan(spark, "hourly_sum_no_gap")
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", plan).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"ts", "event_type", "value"}
    assert "IsNotNull(value)" in plan
