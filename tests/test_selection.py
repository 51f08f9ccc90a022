"""Order statistics without a sort: numbers and hashed keys against plain sorting."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from churnlens.operators import features as Fe
from churnlens.operators import selection


def medians(values):
    v = sorted(values)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


@pytest.mark.parametrize("few", [4, 10_000])
def test_medians_of_awkward_columns(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW_ROWS", few)
    rnd = random.Random(3)
    rows = []
    for k in range(900):
        two = 1.0 if k < 450 else 2.0  # the middle falls between two heavy values
        hole = -1e300 if k < 440 else 1e300 if k > 460 else rnd.random()  # few values between heavy ends
        rows.append((rnd.gauss(0, 1e6), two, hole, 7.0, float(k % 5), None if k % 3 else 5e-324, float("nan") if k % 2 else k + 0.5))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double").repartition(5)
    got = Fe.exact_medians(df, df.columns)
    for i, c in enumerate(df.columns):
        assert got[c] == medians([r[i] for r in rows if r[i] is not None and r[i] == r[i]]), c


def test_median_of_many_distinct_values(spark):
    df = spark.range(0, 400_001, 1, 8).selectExpr("cast(pmod(id * 7919, 400001) AS double) AS v", "cast(NULL AS double) AS empty")
    assert Fe.exact_medians(df, ["v", "empty"]) == {"v": 200_000.0, "empty": None}


@pytest.mark.parametrize("few", [1, 10_000])
def test_smallest_keys(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW_ROWS", few)
    monkeypatch.setattr(selection, "DIGITS", 1)
    ids = [f"c{i}" for i in range(500)] + ["twice"] * 40
    df = spark.createDataFrame([(x, n % 2) for n, x in enumerate(ids)], "id string, label int").repartition(7)
    for label in (0, 1):
        order = sorted((hashlib.md5(x.encode()).hexdigest(), x) for n, x in enumerate(ids) if n % 2 == label)
        for n in (1, 2, 100, len(order)):
            assert selection.smallest_keys(df, "label", F.md5("id"), "id", {label: n}) == {label: order[n - 1]}
    assert selection.smallest_keys(df, "label", F.md5("id"), "id", {0: 0}) == {}


def test_split_is_a_filter(spark):
    df = spark.range(3000).selectExpr("concat('id', id) AS customer_id", "cast(id % 3 = 0 AS int) AS churn")
    split = Fe.stratified_split(df)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    got = {(r.churn, r.is_test): r["count"] for r in split.groupBy("churn", "is_test").count().collect()}
    assert got == {(0, False): 1600, (0, True): 400, (1, False): 800, (1, True): 200}
    moved = Fe.stratified_split(df.repartition(17))
    assert moved.exceptAll(split).count() == 0


def test_ids_that_repeat_stay_on_one_side(spark):
    df = spark.createDataFrame([(f"id{i // 10}", 1) for i in range(1000)], "customer_id string, churn int")
    split = Fe.stratified_split(df)
    sides = split.groupBy("customer_id").agg(F.countDistinct("is_test").alias("n")).agg(F.max("n")).first()[0]
    assert sides == 1 and 200 <= split.where("is_test").count() < 210


def test_unlabelled_rows_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "customer_id string, churn int")
    assert [r.is_test for r in Fe.stratified_split(df).collect()] == [False, False]
    assert Fe.stratified_split(df.limit(0)).count() == 0
