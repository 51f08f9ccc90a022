"""End-to-end jobs: train, evaluate, segment, score, and write the outputs.

Lifecycle (one Spark application, or separate ones that share the written outputs):

    raw table -> clean (V1-V6) -> split (F7) -> tree (M1) -> evaluate (E6, D1)
                              \\-> cluster matrix (K1) -> k search (K5) -> k-means (K2)
                                   -> profiles + personas (C1-C4)
    raw table -> scored table (R2) written as parquet; dashboard queries (Q*) read it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.operators import churn as M
from churnlens.operators import personas as P
from churnlens.operators import quality as V
from churnlens.operators import segments as K
from churnlens.plans.bundle import Bundle
from churnlens.sources import sinks

REPORTED_DRIVERS = 10  # fixed: drivers named in the evaluation report
EVALUATION_SCHEMA = (
    "accuracy double, precision double, recall double, f1 double, roc_auc double, "
    "confusion_matrix struct<tn: long, fp: long, fn: long, tp: long>, "
    "report array<struct<label: string, precision: double, recall: double, f1: double, support: long>>, "
    "n_train long, n_test long, top_drivers array<struct<feature: string, importance: double, rank: int>>")


@dataclass
class Artifacts:
    cleaned: DataFrame
    churn: M.ChurnModel
    split: DataFrame
    segments: K.ClusterModel
    search: DataFrame | None
    chosen_k: int | None
    profiles: DataFrame

    @property
    def k(self) -> int:
        return self.segments.k

    @cached_property
    def bundle(self) -> Bundle:
        """The scoring pipeline of these models, as S7 saves it."""
        return Bundle.of(self.churn, self.segments, self.profiles)


def train_all(df: DataFrame, k: int | None = K.K_FINAL, search: tuple[int, int] | None = K.K_RANGE,
              n_init: int = K.N_INIT, numeric: list[str] | None = None, categorical: list[str] | None = None) -> Artifacts:
    """Train the churn tree and the personas on a cleaned table."""
    if numeric is None or categorical is None:
        numeric, categorical = V.split_columns(df)
    churn, split = M.train_churn_model(df, numeric=numeric, categorical=categorical)
    seg, table = K.train_segments(df, k=k, search=search, n_init=n_init, numeric=numeric, categorical=categorical,
                                  fill=churn.fill)
    chosen = None
    if table is not None:
        best = table.orderBy(F.desc("silhouette"), "k").first()
        chosen = int(best["k"]) if best else None
    profiles = P.cluster_profiles(seg.transform(df))
    return Artifacts(df, churn, split, seg, table, chosen, profiles)


def score_customers(df: DataFrame, art: Artifacts | Bundle) -> DataFrame:
    """R2: probability, risk, cluster, persona and Yes/No label for every row, its own values unchanged."""
    return bundle_of(art).score(df)


def predict_batch(df: DataFrame, art: Artifacts | Bundle) -> DataFrame:
    """The single-record prediction payload for every valid row of ``df`` (narrow).

    Flags are trimmed and records checked first; ``Bundle.predict`` also returns the rejected ones.
    """
    return bundle_of(art).predict(df)[0]


def bundle_of(art: Artifacts | Bundle) -> Bundle:
    return art if isinstance(art, Bundle) else art.bundle


def metrics_row(art: Artifacts) -> DataFrame:
    """E6 summary: accuracy, precision, recall, F1 and ROC-AUC in one row."""
    ev = M.evaluate_model(SparkSession.getActiveSession(), art.churn, art.split)
    return ev["metrics"].withColumn("roc_auc", ev["roc_auc"].scalar())


def evaluation_record(art: Artifacts, n_drivers: int = REPORTED_DRIVERS) -> DataFrame:
    """The whole hold-out evaluation as one row: scores, confusion matrix, per-class report, sizes, top drivers.

    Built from E6's parts, each of which has a number of rows fixed by the classes, or by ``n_drivers``.
    """
    spark = SparkSession.getActiveSession()
    ev = M.evaluate_model(spark, art.churn, art.split)
    scores = ev["metrics"].withColumn("roc_auc", ev["roc_auc"].scalar()).first()
    matrix = ev["confusion_matrix"].first()
    sizes = M.model_metadata(art.churn, art.split).first()
    report = ev["report"].orderBy("position").collect()
    drivers = ev["drivers"].orderBy("rank").limit(n_drivers).collect()
    ev["scored"].unpersist()
    row = (*[scores[c] for c in ("accuracy", "precision", "recall", "f1", "roc_auc")], tuple(matrix[c] for c in ("tn", "fp", "fn", "tp")),
           [tuple(r[c] for c in ("label", "precision", "recall", "f1", "support")) for r in report], sizes["n_train"], sizes["n_test"],
           [(d["feature"], d["importance"], d["rank"]) for d in drivers])
    return spark.createDataFrame([row], EVALUATION_SCHEMA)


def write_outputs(spark: SparkSession, art: Artifacts, out_dir: str) -> dict:
    """S3-S7 plus the scored table, under ``out_dir`` (shared storage on a cluster)."""
    out = out_dir.rstrip("/")
    paths = {
        "drivers": sinks.write_drivers(M.feature_importance(spark, art.churn), f"{out}/feature_importance"),
        "profiles": sinks.write_profiles(art.profiles, f"{out}/cluster_profiles"),
        "metrics": sinks.write_metrics(evaluation_record(art), f"{out}/metrics"),
    }
    if art.search is not None:
        paths["k_search"] = sinks.write_k_search(art.search, art.chosen_k, f"{out}/kmeans_search", art.k)
    art.churn.save(f"{out}/models/churn")
    art.segments.save(f"{out}/models/segments")
    art.bundle.save(f"{out}/models/scoring")  # all that another application needs: Bundle.load
    paths["scoring"] = f"{out}/models/scoring"
    paths["scored"] = sinks.write_scored(score_customers(art.cleaned, art), f"{out}/scored_customers")
    return paths
