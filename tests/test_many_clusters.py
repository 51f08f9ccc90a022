import random

import pytest

from churnlens.operators import features as Fe
from churnlens.operators import segments as K


def points(spark):
    r = random.Random(8)
    rows = [(i, i % 23, [r.uniform(-1, 1) + i % 23, r.uniform(-1, 1), r.uniform(-1, 1)]) for i in range(300)] + [(300, 99, [50.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "id long, c int, v array<double>")


def test_layout_follows_the_rows_alone(spark):
    assert [K.layout_partitions(spark, n) for n in (0, 1, 10**6, 10**6 + 1, 10**9)] == [1, 1, 1, 2, 1000]


def test_large_cluster_tables_are_joined(spark):
    df = points(spark)
    want = K.silhouette(df, "v", "c").first()["silhouette"]
    assert K.silhouette(df, "v", "c", limit=5).first()["silhouette"] == pytest.approx(want, abs=1e-12)
    centres = K.centroids(df, "v", "c")
    near = K.assign_cluster(df, "v", centres).orderBy("id").collect()
    assert K.assign_cluster(df, "v", centres, limit=5).orderBy("id").collect() == near


def test_label_domain(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, None)], "id int, churn int")
    assert Fe.class_counts(df, "churn") == [(0, 1), (1, 2)]
    with pytest.raises(ValueError, match="other than 0 and 1"):
        Fe.class_counts(df.selectExpr("id", "id AS churn"), "churn")


def test_starts_keep_their_own_points(spark, monkeypatch):
    """MLlib keeps a start's points itself only where the matrix it is given is not persisted; few starts run at once on many partitions."""
    r = random.Random(5)
    rows = [(i, float(r.choice([0, 5, 9])) + r.random(), r.random(), r.choice("ab"), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "customer_id long, x double, y double, c string, churn int")
    running, most, levels, fit = [0], [0], [], K._fit_one

    def watched(vectors, *args):
        levels.append((vectors.storageLevel.useMemory, vectors.storageLevel.useDisk))
        running[0] += 1
        most[0] = max(most[0], running[0])
        try:
            return fit(vectors, *args)
        finally:
            running[0] -= 1

    monkeypatch.setattr(K, "_fit_one", watched)
    slots = spark.sparkContext.defaultParallelism
    model, table = K.train_segments(df, k=3, search=(2, 3), n_init=3, numeric=["x", "y"], categorical=["c"], n_partitions=2 * slots)
    assert levels == [(False, False)] * 6 and most[0] <= 2
    assert model.k == 3 and table.count() == 2
    assert [K.starts_at_once(n, 12) for n in (1, 2, 6, 12, 1000)] == [16, 12, 4, 2, 2]
