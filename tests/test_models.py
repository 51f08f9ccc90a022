"""Invariants of the trained models and cross-checks against MLlib's evaluators."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.sql import functions as F

from churnlens.operators import churn as M
from churnlens.operators import features as Fe
from churnlens.operators import metrics as E
from churnlens.operators import segments as K
from churnlens.plans.registry import CATEGORICAL, NUMERIC, cleaned

from conftest import SF_CHECK, SF_SMALL


@pytest.fixture(scope="module")
def data(spark):
    return cleaned(spark, SF_CHECK).persist()


@pytest.fixture(scope="module")
def tree(data):
    return M.train_churn_model(data, numeric=NUMERIC, categorical=CATEGORICAL)


def test_split_is_exact_and_disjoint(spark, data):
    split = Fe.stratified_split(data)
    n = data.count()
    counts = {(r.churn, r.is_test): r["count"] for r in split.groupBy("churn", "is_test").count().collect()}
    per_class = [counts[(0, True)] + counts[(0, False)], counts[(1, True)] + counts[(1, False)]]
    assert [counts[(0, True)], counts[(1, True)]] == Fe.holdout_counts(per_class)
    assert counts[(0, True)] + counts[(1, True)] == -(-n * 2 // 10)  # ceil(0.2 x n) in total
    assert split.count() == n and split.select("cust_key").distinct().count() == n
    # a pure function of (id, seed): other partition counts give the same rows
    again = Fe.stratified_split(data.repartition(3), n_partitions=5)
    a = {r.cust_key for r in split.filter("is_test").collect()}
    b = {r.cust_key for r in again.filter("is_test").collect()}
    assert a == b


def test_allocation_like_reference():
    # 0.2 x 1378 = 275.6 -> 276 test rows; train 1102 split 579.0 / 522.99 -> 579 / 523
    assert Fe.holdout_counts([724, 654]) == [145, 131]
    assert Fe.holdout_counts([5, 5]) == [1, 1]  # ceil(2.0) = 2 test rows
    assert Fe.allocate([1, 1, 1], 2) == [1, 1, 0]  # equal remainders: lower classes first
    assert sum(Fe.holdout_counts([2900, 100])) == 600


def test_tree_invariants(spark, tree):
    model, split = tree
    imps = model.importances()
    assert all(v >= 0 for v in imps) and abs(sum(imps) - 1.0) < 1e-9
    assert len(imps) == len(model.names)
    train = split.filter(~F.col("is_test"))
    scored = model.model.stages[-1].copy({model.model.stages[-1].leafCol: "leaf"}).transform(
        model.model.transform(Fe.impute(train, model.fill)).drop("churn_probability"))
    assert scored.groupBy("leaf").count().agg(F.min("count")).first()[0] >= M.MIN_SAMPLES_LEAF
    probs = model.transform(split).agg(F.min("churn_probability"), F.max("churn_probability")).first()
    assert 0.0 <= probs[0] <= probs[1] <= 1.0


def test_auc_matches_mllib(spark, tree):
    model, split = tree
    test = model.transform(split.filter("is_test")).select(F.col("churn").alias("label"),
                                                           F.col("churn_probability").alias("score"), "prediction")
    ours = E.roc_auc(test).first()[0]
    pts = sorted((r.fpr, r.tpr) for r in E.roc_curve(test).collect())
    curve_area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    full = E.roc_curve(test, drop_intermediate=False).count()
    assert len(pts) <= full
    mllib = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(
        test.withColumn("label", F.col("label").cast("double")))
    assert abs(ours - mllib) < 1e-9 and abs(curve_area - ours) < 1e-12


def test_drivers_rank_and_top(spark, tree):
    model, _ = tree
    d = M.feature_importance(spark, model)
    rows = d.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert all(rows[i].importance >= rows[i + 1].importance for i in range(len(rows) - 1))
    assert M.top_drivers(d, 5).count() == 5


def test_risk_factors_numeric_prefix_and_active_slots(spark):
    from churnlens.operators.scoring import risk_factors

    names = ["tenure", "monthly_charges", "contract_One year", "contract_Two year", "tenure_bucket_x"]
    imps = [0.3, 0.0, 0.3, 0.2, 0.2]
    df = spark.createDataFrame([([5.0, 70.123456, 1.0, 0.0, 0.0],)], "v array<double>")
    got = df.select(risk_factors(F.col("v"), names, imps, ["tenure", "monthly_charges"], 5).alias("f")).first().f
    # importance ties keep feature order; inactive slot skipped; zero importance skipped; prefix counts as numeric
    assert [x.feature for x in got] == ["tenure", "contract_One year", "tenure_bucket_x"]
    assert got[0].value == 5.0


def test_kmeans_cross_checks(spark, data):
    enc, names = K.cluster_matrix(data, NUMERIC, CATEGORICAL)
    vec = enc.transform(data).select("cust_key", "scaled").persist()
    stats = Fe.slot_statistics(vec, names, "scaled").collect()
    assert all(abs(r["mean"]) < 1e-9 for r in stats)
    assert all(abs(r["std"] - 1.0) < 1e-9 or r["std"] < 1e-12 for r in stats)  # population std is 1
    costs = []
    for k in (2, 3, 4):
        m = K.fit_kmeans(vec, k, n_init=3)
        lab = m.transform(vec)
        assert abs(K.inertia(lab, "scaled", "cluster_id").first()[0] - m.summary.trainingCost) < 1e-6 * m.summary.trainingCost
        ev = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster_id", distanceMeasure="squaredEuclidean")
        assert abs(K.silhouette(lab, "scaled", "cluster_id").first()[0] - ev.evaluate(lab)) < 1e-9
        cents = K.centroids(lab, "scaled", "cluster_id")
        assert K.assign_cluster(lab, "scaled", cents, "nearest").filter("nearest != cluster_id").count() == 0
        costs.append(m.summary.trainingCost)
    assert costs[0] >= costs[1] >= costs[2]


def test_same_seed_same_clusters(spark):
    df = cleaned(spark, SF_SMALL)
    enc, _ = K.cluster_matrix(df, NUMERIC, CATEGORICAL)
    vec = enc.transform(df).select("customer_id", "scaled")
    a = K.fit_kmeans(K.canonical_layout(vec.repartition(1), "customer_id", 6), 3, n_init=2)
    b = K.fit_kmeans(K.canonical_layout(vec.repartition(16), "customer_id", 6), 3, n_init=2)
    ca = sorted(tuple(round(x, 6) for x in c) for c in a.clusterCenters())
    cb = sorted(tuple(round(x, 6) for x in c) for c in b.clusterCenters())
    assert ca == cb


def test_unseen_category_and_null(spark):
    fit_rows = spark.createDataFrame([(1.0, "A", 0), (2.0, "B", 1), (3.0, "B", 0), (4.0, "A", 1)], "x double, c string, churn int")
    enc = Fe.fit_encoding(fit_rows, ["x"], ["c"])
    assert enc.names == ["x", "c_A", "c_B"]
    new = spark.createDataFrame([(5.0, "C"), (6.0, None), (7.0, "B")], "x double, c string")
    from pyspark.ml.functions import vector_to_array

    got = [r[0] for r in enc.transform(new).select(vector_to_array("features")).collect()]
    assert got == [[5.0, 0.0, 0.0], [6.0, 0.0, 0.0], [7.0, 0.0, 1.0]]
    # the churn model imputes a null category with the training mode before encoding
    model = M.fit_churn_tree(fit_rows, numeric=["x"], categorical=["c"], min_samples_leaf=1)
    assert model.fill["c"] == "A"  # tie between A and B -> lowest
    out = model.transform(new).collect()
    assert len(out) == 3 and all(0.0 <= r.churn_probability <= 1.0 for r in out)


def test_missing_model_is_a_clear_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="train it first"):
        M.ChurnModel.load(str(tmp_path / "nothing-here"))


@pytest.mark.parametrize("n", [1, 2, 7, 10, 501])
def test_exact_median_and_mode_match_spark(spark, n):
    import random

    rnd = random.Random(n)
    rows = [(rnd.choice([1.0, 2.0, 2.0, 3.5, None, float(rnd.randint(0, 50))]), rnd.randint(-5, 12),
             rnd.choice(["a", "b", "b", "c", None])) for _ in range(n)]
    df = spark.createDataFrame(rows, "x double, y int, s string").repartition(3)
    med = Fe.exact_medians(df, ["x", "y"])
    ref = df.agg(F.median("x"), F.median("y")).first()
    assert (med["x"], med["y"]) == tuple(ref)
    mode = Fe.exact_modes(df, ["s", "y"])
    mref = df.agg(F.mode("s", True), F.mode("y", True)).first()
    assert (mode["s"], mode["y"]) == tuple(mref)


def test_mode_ties_compare_numbers_numerically(spark):
    df = spark.createDataFrame([(9,), (10,), (9,), (10,), (100,)], "y int")
    assert Fe.exact_modes(df, ["y"]) == {"y": 9}


def test_factors_from_sparse_entries_equal_the_dense_form(spark):
    """Same factors from a sparse vector's entries as from an array over all slots; numeric zeros count."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    from churnlens.operators import scoring as R

    names = ["tenure", "monthly_charges", "tenure_band_x", "a_1", "a_2", "b_1", "b_2"]
    imps = [0.2, 0.0, 0.1, 0.3, 0.1, 0.1, 0.0]
    rows = [Vectors.dense([1.23456, 2, 0, 1, 0, 1, 1]), Vectors.sparse(7, {3: 1.0, 5: 1.0, 6: 1.0}), Vectors.sparse(7, {}), Vectors.sparse(7, {0: 0.25, 2: 1.0, 4: 0.4, 5: 0.5})]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], ["id", "v"])
    for n in (1, 3, 5):
        a = df.select("id", R.risk_factors(vector_to_array("v"), names, imps, ["tenure", "monthly_charges"], n).alias("f")).orderBy("id").collect()
        b = df.select("id", R.risk_factors_of_vector(F.col("v"), names, imps, ["tenure", "monthly_charges"], n).alias("f")).orderBy("id").collect()
        assert a == b


def test_factors_of_wide_vectors(spark):
    """50,000 slots, three of them active: the rows' work does not follow the width."""
    import time

    from pyspark.ml.linalg import Vectors

    from churnlens.operators import scoring as R

    width = 50_000
    names = [f"c_{i}" for i in range(width)]
    imps = [1.0 / (i + 1) for i in range(width)]
    df = spark.createDataFrame([(i, Vectors.sparse(width, {i: 1.0, 100 + i: 1.0, 49_000 + i: 1.0})) for i in range(90)] * 20, ["id", "v"])
    start = time.time()
    got = df.select("id", R.risk_factors_of_vector(F.col("v"), names, imps, [], 2).alias("f")).collect()
    assert time.time() - start < 60
    assert all([x.feature for x in r.f] == [f"c_{r.id}", f"c_{100 + r.id}"] for r in got) and len(got) == 1800
