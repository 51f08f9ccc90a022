"""Physical-plan checks: no Python UDFs and no cross joins in any query, broadcast persona
lookup, pushed filters, range-partitioned running sums."""

import pytest

from churnlens.operators import dashboard as Q
from churnlens.plans import registry as reg

from conftest import SF_SMALL


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(reg.QUERIES))
def test_no_python_udf(spark, name):
    plan = plan_of(reg.QUERIES[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
        assert node not in plan, f"{name}: {node}"
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin"):  # no cross joins
        assert node not in plan, f"{name}: {node}"


def test_persona_lookup_is_broadcast(spark):
    plan = plan_of(reg.dashboard_scored(spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan and "LeftOuter" in plan


def test_equality_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "scored")
    reg.dashboard_scored(spark, SF_SMALL).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        df = spark.read.parquet(path)
        view = Q.filter_customers(df, contract="One year", churn="yes", risk_level="High")
        plan = plan_of(view)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "EqualTo(contract,One year)" in pushed and "EqualTo(churn,Yes)" in pushed


def test_prefix_sums_range_partitioned(spark):
    plan = plan_of(reg.QUERIES["E3_roc_auc"](spark, SF_SMALL))
    assert "rangepartitioning" in plan
