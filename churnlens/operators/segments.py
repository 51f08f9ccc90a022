"""Customer segmentation (K1-K6).

* K1: one-hot + assemble + population-std standardisation, fitted as one pipeline.
* K2: MLlib k-means, best of ``n_init`` seeded starts by training cost.  The starts
  are independent Spark jobs over one checkpointed matrix and run concurrently.  The
  matrix is not persisted: MLlib then keeps each start's points as objects for its passes,
  on whichever executor the start runs, instead of decoding cached rows in every pass on
  the one executor that holds them.
* K3 / K4: inertia and silhouette from per-cluster sums (count, vector sum, sum of
  squared norms) - linear in the rows, no pairwise join.  The silhouette uses squared
  Euclidean distance (exact in this form, as Spark's ClusteringEvaluator does); the
  plain Euclidean silhouette has no such decomposition and needs all pairs, which is
  not built (see README).
* K6: nearest centre for each row from a k-row centre table (size checked) embedded
  as literals in array expressions.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.operators.features import SEED, assembler, feature_names, one_hot_stages, standardizer_stages
from churnlens.operators.quality import split_columns
from churnlens.operators.stages import FILLED, FillMissing, filled
from churnlens.session import ensure_checkpoint_dir
from churnlens.sources.schema import ID_COL, LABEL_COL

N_INIT = 10  # fixed: starts per k (best by inertia)
K_FINAL = 4  # fixed: the reference trains its final model with k = 4
K_RANGE = (2, 6)  # fixed: the reference's k search range
MAX_ITER = 300  # fixed: iteration cap per start
TOL = 1e-4  # fixed: convergence tolerance


@dataclass
class ClusterModel:
    """K1 encoding + K2 k-means; ``transform`` adds ``cluster_id``."""

    encoding: PipelineModel
    kmeans: KMeansModel
    numeric: list[str]
    categorical: list[str]
    names: list[str]

    @property
    def k(self) -> int:
        return len(self.kmeans.clusterCenters())

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = self.encoding.transform(df)
        out = self.kmeans.transform(scaled)
        drop = [c for c in out.columns if c.startswith(("_oh_", "_scaled", FILLED)) or c in ("features", "scaled")]
        return out.withColumn("cluster_id", F.col("cluster_id").cast("int")).drop(*drop)

    def save(self, path: str) -> None:
        self.encoding.write().overwrite().save(f"{path}/encoding")
        self.kmeans.write().overwrite().save(f"{path}/kmeans")
        info = json.dumps(dict(numeric=self.numeric, categorical=self.categorical, names=self.names))
        SparkSession.active().createDataFrame([(info,)], "info string").coalesce(1).write.mode("overwrite").text(f"{path}/info")

    @classmethod
    def load(cls, path: str) -> ClusterModel:
        try:
            info = json.loads(SparkSession.active().read.text(f"{path}/info").first()[0])
            return cls(PipelineModel.load(f"{path}/encoding"), KMeansModel.load(f"{path}/kmeans"), info["numeric"], info["categorical"], info["names"])
        except Exception as e:  # noqa: BLE001
            raise FileNotFoundError(f"no readable cluster model at {path}; train and save one first") from e


ROWS_PER_PARTITION = 1_000_000  # k-means matrix rows per partition (~200 MB at 20 slots)


def cluster_matrix(df: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None,
                   label: str = LABEL_COL, with_count: bool = False, fill: dict | None = None):
    """K1: fitted (fill, one-hot, assemble, standardise) pipeline writing ``scaled``; and slot names.

    ``fill`` holds the values for nulls, which go to working copies of the columns; without it
    nulls in numeric columns fail.
    """
    if numeric is None or categorical is None:
        numeric, categorical = split_columns(df, label_col=label)
    stages = [FillMissing(inputCols=[*numeric, *categorical], fills=json.dumps(fill or {}, default=float)),
              *one_hot_stages(categorical, inputs=filled(categorical)), assembler(filled(numeric), categorical)]
    encoding = Pipeline(stages=stages).fit(df)
    names = feature_names(encoding, numeric, categorical)
    n_rows = df.count()
    model = Pipeline(stages=[*encoding.stages, *standardizer_stages(n_rows, len(names), "features", "scaled")]).fit(df)
    return (model, names, n_rows) if with_count else (model, names)


def layout_partitions(spark, n_rows: int) -> int:
    """Partitions for the k-means matrix: a function of the row count alone, so clusters do not change with the cluster's size."""
    return max(1, -(-n_rows // ROWS_PER_PARTITION))


def canonical_layout(vectors: DataFrame, key: str, n_partitions: int | None = None) -> DataFrame:
    """Rows placed by a hash of ``key`` into a fixed number of partitions, sorted inside.

    MLlib's k-means|| seeding samples each partition with a seed derived from the
    partition index, so the clusters depend on how rows are laid out.  After this step
    the layout depends only on the keys and ``n_partitions``, so one seed gives one
    result whatever the upstream partitioning was.
    """
    n = n_partitions or layout_partitions(vectors.sparkSession, vectors.count())
    return vectors.repartition(n, key).sortWithinPartitions(key)


def starts_at_once(n_partitions: int, slots: int, most: int = 16) -> int:
    """Starts to run together: about two tasks for each slot, so that the points they keep stay bounded.  No result depends on it."""
    return max(2, min(most, -(-2 * slots // n_partitions)))


def _fit_one(vectors: DataFrame, k: int, seed: int, max_iter: int, tol: float, features: str) -> KMeansModel:
    # the row solver is what "auto" takes here, after one more pass over the vectors in every start
    km = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol=features, predictionCol="cluster_id", solver="row")
    return km.fit(vectors)


def fit_kmeans(vectors: DataFrame, k: int, seed: int = SEED, n_init: int = N_INIT, max_iter: int = MAX_ITER,
               tol: float = TOL, features: str = "scaled", parallel: int = 16) -> KMeansModel:
    """K2: best of ``n_init`` starts (seeds seed .. seed + n_init - 1) by training cost."""
    return fit_kmeans_many(vectors, [k], seed, n_init, max_iter, tol, features, parallel)[k]


def fit_kmeans_many(vectors: DataFrame, ks: list[int], seed: int = SEED, n_init: int = N_INIT, max_iter: int = MAX_ITER,
                    tol: float = TOL, features: str = "scaled", parallel: int = 16) -> dict[int, KMeansModel]:
    """Best-of-``n_init`` model for every k; all (k, seed) starts are independent jobs run concurrently.

    Ties in cost go to the earliest seed, so the result does not depend on thread timing.
    """
    starts = [(k, seed + i) for k in ks for i in range(n_init)]
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(starts)))) as pool:
        models = list(pool.map(lambda ks_: _fit_one(vectors, ks_[0], ks_[1], max_iter, tol, features), starts))
    best: dict[int, tuple[float, int, KMeansModel]] = {}
    for i, ((k, _), m) in enumerate(zip(starts, models)):
        key = (m.summary.trainingCost, i)
        if k not in best or key < best[k][:2]:
            best[k] = (key[0], key[1], m)
    return {k: v[2] for k, v in best.items()}


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _sq(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)


def cluster_stats(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Per cluster: n, vector sum S and sum of squared norms Q (k rows)."""
    x = F.col(vec)
    v = x if dict(df.dtypes)[vec] == "vector" else array_to_vector(x.cast("array<double>"))
    arr = vector_to_array(v) if dict(df.dtypes)[vec] == "vector" else x.cast("array<double>")
    pre = df.select(F.col(cluster).cast("int").alias("cid"), v.alias("_v"), _sq(arr).alias("_q"))
    agg = pre.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("_v")).alias("_s"), F.sum("_q").alias("q"))
    return agg.select("cid", "n", vector_to_array("_s").alias("s"), "q")


def inertia(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """K3: sum of squared distances to the own cluster's mean = sum_c (Q_c - |S_c|^2 / n_c)."""
    st = cluster_stats(df, vec, cluster)
    return st.agg(F.sum(F.col("q") - _sq(F.col("s")) / F.col("n")).alias("inertia"))


MAX_CLUSTERS = 10_000  # clusters embedded in per-row expressions; larger cluster tables are joined


def few_rows(df: DataFrame, limit: int = MAX_CLUSTERS) -> list | None:
    """The rows of a cluster table, or None past ``limit``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def cluster_chunks(table: DataFrame, limit: int) -> list[DataFrame]:
    """A written cluster table as one-row tables (``_chunk``: its rows as structs), of about ``limit`` clusters each."""
    n = -(-table.count() // limit)
    place = F.pmod(F.xxhash64("cid"), F.lit(n))
    return [table.where(place == i).agg(F.collect_list(F.struct(*table.columns)).alias("_chunk")) for i in range(n)]


def _lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def silhouette(df: DataFrame, vec: str, cluster: str, limit: int = MAX_CLUSTERS) -> DataFrame:
    """K4: mean silhouette with squared Euclidean distance; a singleton cluster scores 0.

    Mean squared distance from x to the members of cluster c is
    (n_c |x|^2 - 2 x.S_c + Q_c) / n_c, and over n_c - 1 for x's own cluster.  The k
    cluster sums (k x dimension) are computed by one aggregate and enter the per-row
    expression as literals; past ``limit`` clusters they are joined as tables.
    """
    table = cluster_stats(df, vec, cluster)
    stats = few_rows(table, limit)
    x = vector_to_array(F.col(vec)) if dict(df.dtypes)[vec] == "vector" else F.col(vec).cast("array<double>")
    pts = df.select(F.col(cluster).cast("int").alias("own"), x.alias("x"))
    xx = _sq(F.col("x"))
    if stats is None:
        return _joined_silhouette(pts, table, limit)
    d = F.array(*[
        F.struct(F.lit(int(r["cid"])).alias("cid"), F.lit(int(r["n"])).alias("n"),
                 (F.lit(float(r["n"])) * xx - 2.0 * _dot(F.col("x"), _lit_array(r["s"])) + F.lit(float(r["q"]))).alias("tot"))
        for r in stats
    ])
    own = F.filter(d, lambda e: e["cid"] == F.col("own"))[0]
    others = F.filter(d, lambda e: e["cid"] != F.col("own"))
    a = F.when(own["n"] > 1, own["tot"] / (own["n"] - 1))
    b = F.array_min(F.transform(others, lambda e: e["tot"] / e["n"]))
    s = F.when((own["n"] <= 1) | b.isNull(), F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return pts.select(s.alias("s")).agg(F.avg("s").alias("silhouette"))


def _joined_silhouette(pts: DataFrame, table: DataFrame, limit: int) -> DataFrame:
    """``silhouette`` of (own, x) with the cluster sums as tables: the own ones by id, the others a chunk at a time."""
    ensure_checkpoint_dir(pts.sparkSession)
    table = table.checkpoint()
    x, xx = F.col("x"), _sq(F.col("x"))

    def total(n: Column, s: Column, q: Column) -> Column:
        return n.cast("double") * xx - 2.0 * _dot(x, s) + q

    d = pts.join(table.withColumnRenamed("cid", "own"), "own")
    d = d.select("own", "x", "n", F.when(F.col("n") > 1, total(F.col("n"), F.col("s"), F.col("q")) / (F.col("n") - 1)).alias("a"), F.lit(None).cast("double").alias("b"))
    for chunk in cluster_chunks(table, limit):
        others = F.transform(F.filter("_chunk", lambda e: e["cid"] != F.col("own")), lambda e: total(e["n"], e["s"], e["q"]) / e["n"])
        d = d.crossJoin(F.broadcast(chunk)).select("own", "x", "n", "a", F.least("b", F.array_min(others)).alias("b"))
    s = F.when((F.col("n") <= 1) | F.col("b").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return d.select(s.alias("s")).agg(F.avg("s").alias("silhouette"))


def centroids(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Mean vector per cluster (k rows): (cid, centre array<double>)."""
    st = cluster_stats(df, vec, cluster)
    return st.select("cid", F.transform("s", lambda v: v / F.col("n")).alias("centre"))


def assign_cluster(df: DataFrame, vec: str, centres: DataFrame, out: str = "cluster_id",
                   limit: int = MAX_CLUSTERS) -> DataFrame:
    """K6: nearest centre by squared distance; ties go to the smaller id.

    ``centres`` (cid, centre) has one row per cluster; the centres enter the per-row
    expression as literals, past ``limit`` clusters as tables, a chunk at a time.
    """
    rows = few_rows(centres, limit)
    x = vector_to_array(F.col(vec)) if dict(df.dtypes)[vec] == "vector" else F.col(vec).cast("array<double>")
    if rows is None:
        ensure_checkpoint_dir(df.sparkSession)
        near = F.lit(None).cast("struct<d:double,cid:int>")
        d = df.select(F.struct(*df.columns).alias("_row"), x.alias("_x"), near.alias("_near"))
        for chunk in cluster_chunks(centres.select(F.col("cid").cast("int").alias("cid"), "centre").checkpoint(), limit):
            gaps = F.transform("_chunk", lambda e: F.struct(F.aggregate(F.zip_with("_x", e["centre"], lambda a, b: (a - b) * (a - b)),
                                                                        F.lit(0.0), lambda acc, v: acc + v).alias("d"), e["cid"].alias("cid")))
            d = d.crossJoin(F.broadcast(chunk)).select("_row", "_x", F.least("_near", F.array_min(gaps)).alias("_near"))
        return d.select("_row.*", "_near").withColumn(out, F.col("_near.cid")).drop("_near")
    dist = F.array(*[
        F.struct(F.aggregate(F.zip_with(x, _lit_array(r["centre"]), lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                             lambda acc, v: acc + v).alias("d"), F.lit(int(r["cid"])).alias("cid"))
        for r in rows
    ])
    return df.withColumn(out, F.array_min(dist)["cid"])


def choose_k(vectors: DataFrame, k_min: int = K_RANGE[0], k_max: int = K_RANGE[1], seed: int = SEED,
             n_init: int = N_INIT, features: str = "scaled", parallel: int = 16) -> tuple[DataFrame, int, dict]:
    """K5: (k, inertia, silhouette) per k and the best k (highest silhouette, smallest k on ties).

    ``vectors`` should be checkpointed by the caller; each k fits ``n_init`` starts over it.
    """
    spark = vectors.sparkSession
    ks = list(range(k_min, k_max + 1))
    models = fit_kmeans_many(vectors, ks, seed, n_init, features=features, parallel=parallel)

    evaluator = ClusteringEvaluator(featuresCol=features, predictionCol="cluster_id", distanceMeasure="squaredEuclidean")

    def score(k):
        # MLlib's evaluator states the same squared-Euclidean silhouette as ``silhouette`` (tested equal)
        sil = evaluator.evaluate(models[k].transform(vectors))
        return (k, float(models[k].summary.trainingCost), float(sil))

    with ThreadPoolExecutor(max_workers=len(ks)) as pool:
        rows = list(pool.map(score, ks))
    table = spark.createDataFrame(rows, "k int, inertia double, silhouette double")
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    return table, best, models


def train_segments(df: DataFrame, k: int | None = K_FINAL, search: tuple[int, int] | None = K_RANGE,
                   seed: int = SEED, n_init: int = N_INIT, label: str = LABEL_COL,
                   numeric: list[str] | None = None, categorical: list[str] | None = None,
                   id_col: str = ID_COL, n_partitions: int | None = None, fill: dict | None = None):
    """K1 + K5 + K2: returns (ClusterModel, k-search table or None).

    ``k=None`` takes the best silhouette of the search; an integer fixes k (the
    reference fixes 4 after searching 2..6).  The scaled matrix is checkpointed to the
    shared checkpoint folder so the many k-means jobs re-read it instead of the
    lineage.
    """
    if numeric is None or categorical is None:
        numeric, categorical = split_columns(df, label_col=label)
    enc, names, n_rows = cluster_matrix(df, numeric, categorical, label, with_count=True, fill=fill)
    ensure_checkpoint_dir(df.sparkSession)  # the shared folder named by spark.checkpoint.dir
    n_partitions = n_partitions or layout_partitions(df.sparkSession, n_rows)
    laid_out = canonical_layout(enc.transform(df).select(id_col, "scaled"), id_col, n_partitions)
    vectors = laid_out.checkpoint(eager=True)
    parallel = starts_at_once(n_partitions, df.sparkSession.sparkContext.defaultParallelism)
    table, best = None, None
    models = {}
    if search:
        table, best, models = choose_k(vectors, search[0], search[1], seed, n_init, parallel=parallel)
    final_k = k if k is not None else best
    km = models.get(final_k) or fit_kmeans(vectors, final_k, seed, n_init, parallel=parallel)
    return ClusterModel(enc, km, numeric, categorical, names), table
