"""Range-partitioned running sums equal a plain running sum, whatever the layout."""

import random

import pytest
from pyspark.sql import functions as F

from churnlens.operators import features as Fe
from churnlens.operators.ordered import prefix_sums


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_prefix_sums_exact(spark, parts):
    rnd = random.Random(7)
    # a hot range: most keys fall into [0, 10)
    keys = rnd.sample(range(10_000), 300) + rnd.sample(range(10_000, 1_000_000), 60)
    rows = [(k, rnd.randint(0, 5), rnd.random()) for k in keys]
    df = spark.createDataFrame(rows, "k long, a long, b double").repartition(5)
    out = {r.k: (r.cum_a, r.cum_b) for r in prefix_sums(df, ["k"], ["a", "b"], parts).collect()}
    run_a, run_b = 0, 0.0
    for k, a, b in sorted(rows):
        run_a += a
        run_b += b
        assert out[k][0] == run_a
        assert abs(out[k][1] - run_b) < 1e-9


def test_prefix_sums_descending_order(spark):
    df = spark.createDataFrame([(i, 1) for i in range(50)], "k int, one int")
    out = {r.k: r.cum_one for r in prefix_sums(df, [F.col("k").desc()], ["one"], 4).collect()}
    assert out[49] == 1 and out[0] == 50


def test_split_with_dominant_class(spark):
    rows = [(f"id{i:05d}", 1 if i < 2900 else 0) for i in range(3000)]  # one class holds 97% of rows
    df = spark.createDataFrame(rows, "customer_id string, churn int")
    split = Fe.stratified_split(df, n_partitions=6)
    got = {(r.churn, r.is_test): r["count"] for r in split.groupBy("churn", "is_test").count().collect()}
    assert got[(1, True)] == 580 and got[(0, True)] == 20  # 600 test rows in proportion
    assert got[(1, False)] == 2320 and got[(0, False)] == 80


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_next_values_cross_partitions(spark, parts):
    rows = [(k, k * 10) for k in range(0, 200, 3)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(3)
    got = {r.k: r.next_v for r in prefix_sums(df, ["k"], ["v"], parts, next_cols=["v"]).collect()}
    keys = [k for k, _ in rows]
    for a, b in zip(keys, keys[1:]):
        assert got[a] == b * 10
    assert got[keys[-1]] is None


def test_roc_curve_drops_straight_runs(spark):
    from churnlens.operators import metrics as E

    # scores 0.9, 0.8, 0.7 each hold one positive: equal steps -> 0.8 is dropped
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4)]
    df = spark.createDataFrame(rows, "label int, score double")
    pts = [(r.threshold, r.fpr, r.tpr) for r in E.roc_curve(df, n_partitions=3).orderBy(F.desc("threshold")).collect()]
    assert pts == [(float("inf"), 0.0, 0.0), (0.9, 0.0, 0.25), (0.7, 0.0, 0.75), (0.5, 1.0, 0.75), (0.4, 1.0, 1.0)]


@pytest.mark.parametrize("parts", [8, 32])
@pytest.mark.parametrize("extra", [True, False])
def test_running_sums_beyond_the_sampling_size(spark, parts, extra):
    df = spark.range(0, 300_000, 1, 8).selectExpr("xxhash64(id) AS k", "1L AS one", "'x' AS other")
    out = prefix_sums(df if extra else df.select("k", "one"), ["k"], ["one"], parts)
    got = out.selectExpr("max(cum_one) AS top", "count(DISTINCT cum_one) AS n").first()
    assert (got["top"], got["n"]) == (300_000, 300_000)


def test_buckets_follow_the_rows_alone(spark, monkeypatch):
    from churnlens.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 1_000)
    df = spark.range(0, 40_000, 1, 8).selectExpr("cast(id AS double) / 7 AS k", "id % 11 AS a")
    bounds = ordered.bucket_bounds(df, F.col("k"))
    assert len(bounds) == len(ordered.bucket_bounds(df.repartition(3), F.col("k"))) == 39
    out = prefix_sums(df, [F.col("k").desc()], ["a"], next_cols=["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Scan ExistingRDD" not in plan
    got = {r.k: (r.cum_a, r.next_k) for r in out.collect()}
    total, rows = 0, [(i / 7, i % 11) for i in range(40_000)]
    for (k, a), following in zip(reversed(rows), [*[r[0] for r in reversed(rows)][1:], None]):
        total += a
        assert got[k] == (total, following)


def test_odd_keys(spark):
    keys = [None, float("-inf"), -1.5, 0.0, 2.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(k, 1) for k in keys], "k double, one int")
    for order, want in ((F.col("k").asc(), keys), (F.col("k").desc(), keys[::-1])):
        for n in (1, 3, 6):
            out = prefix_sums(df, [order], ["one"], n, next_cols=["k"]).collect()
            rows = sorted(out, key=lambda r: r.cum_one)
            assert [str(r.k) for r in rows] == [str(k) for k in want]
            assert [str(r.next_k) for r in rows] == [str(k) for k in [*want[1:], None]]


def test_empty_table(spark):
    df = spark.createDataFrame([], "k double, one int")
    assert prefix_sums(df, ["k"], ["one"], next_cols=["one"]).count() == 0
