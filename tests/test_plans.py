"""Plan guards: no cartesian products / nested-loop joins (no cross joins),
no Python UDF evaluation, filters and column pruning reach the scans."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF

CHECKED = ["activity_breakdown", "by_chain", "chain_activity_dist", "activity_pivot_chain", "time_series_weekly",
           "dedup_tx", "merge_holders", "holding_period", "holder_features", "request_rate", "run_state",
           "user_runs", "read_api_transfers", "conclusions", "model_check", "eval_multiclass", "summary_by_stablecoin"]
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas"]


@pytest.mark.parametrize("name", CHECKED)
def test_plan_has_no_cross_join_or_python(spark, name):
    df = E.queries()[name](spark, SF)
    df.collect()  # of this very plan, so that the adaptive one is final
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not plan.startswith("AdaptiveSparkPlan") or plan.startswith("AdaptiveSparkPlan isFinalPlan=true")
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op} in plan"


def test_scan_is_pruned(spark):
    from tokenflow.sources import testdata as TD
    plan = TD.raw_transfers(spark, SF).select("amount")._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "lineitem" in ln][0]
    assert "l_returnflag" not in scan and "l_extendedprice" in scan


@pytest.mark.parametrize("threshold", ["-1", "100MB"])
def test_dedup_shares_the_exchange_of_the_join(spark, threshold):
    """Transfers are exchanged once, by order key, whether the join is a merge or a broadcast."""
    from tokenflow.sources import testdata as TD
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = TD.canonical_tx(spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("hashpartitioning(l_orderkey") == 1 and "hashpartitioning(_tid" not in plan
    assert plan.count("hashpartitioning") == (2 if threshold == "-1" else 1)
