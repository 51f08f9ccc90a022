"""Churn tree, drivers and hold-out evaluation.

M1 uses MLlib's ``DecisionTreeRegressor`` on the 0/1 label with balanced class
weights: for a 0/1 label the variance criterion is half the Gini impurity, so it grows
the Gini tree, and its leaf value is the weighted churn share, i.e. P(churn).  (The
classifier merges sibling leaves that predict the same class, losing probabilities
and importances.)  Training is MLlib's distributed level-by-level histogram search.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.functions.columns import shorten
from churnlens.functions.rounding import round_exact
from churnlens.operators import metrics as E
from churnlens.operators.features import (
    SEED, TEST_SIZE, assembler, class_counts, feature_names, imputation_values, one_hot_stages,
    stratified_split,
)
from churnlens.operators.ordered import prefix_sums
from churnlens.operators.quality import split_columns
from churnlens.operators.scoring import risk_factors_of_vector
from churnlens.operators.stages import FILLED, ChurnClass, FillMissing, filled
from churnlens.sources.schema import DRIVER_SCHEMA, ID_COL, LABEL_COL

MAX_DEPTH = 8  # fixed: reference tree depth
MIN_SAMPLES_LEAF = 20  # fixed: reference minimum leaf size
TOP_DRIVERS = 15  # fixed: default drivers served (1..50)
MIN_BAR_SCALE = 0.0001  # fixed: floor of the largest importance for bar widths


@dataclass
class ChurnModel:
    """M1 output: imputation (into working columns), fitted encoding and tree as one pipeline."""

    model: PipelineModel
    numeric: list[str]
    categorical: list[str]
    fill: dict
    names: list[str]
    meta: dict = field(default_factory=dict)

    @property
    def tree(self):
        return self.model.stages[-1]

    def importances(self) -> list[float]:
        return [float(x) for x in self.tree.featureImportances.toArray()]

    def transform(self, df: DataFrame, keep_features: bool = False) -> DataFrame:
        """M3: ``churn_probability`` and ``prediction`` (p > 0.5; a tie gives 0)."""
        out = ChurnClass().transform(self.model.transform(df))
        drop = [c for c in out.columns if c.startswith(("_oh_", FILLED))]
        if not keep_features:
            drop.append("features")
        return out.drop(*drop)

    def with_risk_factors(self, df: DataFrame, top_n: int = 5) -> DataFrame:
        """R5 on the model's own feature vector (imputed numerics + one-hot slots)."""
        scored = self.transform(df, keep_features=True)
        col = risk_factors_of_vector(F.col("features"), self.names, self.importances(), self.numeric, top_n)
        return scored.withColumn("risk_factors", col).drop("features")

    # S7 -------------------------------------------------------------------
    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{path}/pipeline")
        info = dict(numeric=self.numeric, categorical=self.categorical, fill=self.fill, names=self.names, meta=self.meta)
        spark.createDataFrame([(json.dumps(info, default=str),)], "info string").coalesce(1).write.mode("overwrite").text(
            f"{path}/info")

    @classmethod
    def load(cls, path: str) -> ChurnModel:
        spark = SparkSession.getActiveSession()
        try:
            model = PipelineModel.load(f"{path}/pipeline")
            info = json.loads(spark.read.text(f"{path}/info").first()[0])
        except Exception as e:  # noqa: BLE001
            raise FileNotFoundError(f"no readable churn model at {path}; train it first") from e
        return cls(model, info["numeric"], info["categorical"], info["fill"], info["names"], info.get("meta", {}))


def balanced_weight(df: DataFrame, label: str = LABEL_COL):
    """Weight column n / (classes x class count); class counts are one row per class."""
    counts = dict(class_counts(df, label))
    n, k = sum(counts.values()), len(counts)
    expr = None
    for lab, cnt in counts.items():
        w = F.lit(n / (k * cnt))
        expr = F.when(F.col(label) == lab, w) if expr is None else expr.when(F.col(label) == lab, w)
    return expr if expr is not None else F.lit(1.0)


def fit_churn_tree(train: DataFrame, label: str = LABEL_COL, max_depth: int = MAX_DEPTH,
                   min_samples_leaf: int = MIN_SAMPLES_LEAF, seed: int = SEED, max_bins: int = 256,
                   numeric: list[str] | None = None, categorical: list[str] | None = None) -> ChurnModel:
    """M1: impute (F1/F2), one-hot (F3), assemble (F5), weighted Gini tree."""
    if numeric is None or categorical is None:
        numeric, categorical = split_columns(train, label_col=label)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)  # read by several jobs below, and by every tree level
    fill = imputation_values(train, numeric, categorical)
    data = train.withColumns({"_y": F.col(label).cast("double"), "_w": balanced_weight(train, label)})
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="_y", weightCol="_w", predictionCol="churn_probability",
                                 maxDepth=max_depth, minInstancesPerNode=min_samples_leaf, maxBins=max_bins, seed=seed)
    pipe = Pipeline(stages=[FillMissing(inputCols=[*numeric, *categorical], fills=json.dumps(fill, default=float)),
                            *one_hot_stages(categorical, inputs=filled(categorical)), assembler(filled(numeric), categorical), tree])
    model = pipe.fit(data)
    train.unpersist()
    names = feature_names(model, numeric, categorical)
    meta = dict(numeric_cols=numeric, categorical_cols=categorical, feature_names=names, random_state=seed,
                max_depth=max_depth, min_samples_leaf=min_samples_leaf)
    return ChurnModel(model, list(numeric), list(categorical), fill, names, meta)


def train_churn_model(df: DataFrame, label: str = LABEL_COL, id_col: str = ID_COL, test_size: float = TEST_SIZE,
                      seed: int = SEED, **tree_args) -> tuple[ChurnModel, DataFrame]:
    """Split (F7) then fit (M1) on the training rows; returns (model, split frame)."""
    split = stratified_split(df, label, id_col, test_size, seed).persist(StorageLevel.MEMORY_AND_DISK)
    model = fit_churn_tree(split.filter(~F.col("is_test")).drop("is_test"), label, seed=seed, **tree_args)
    model.meta["test_size"] = test_size
    return model, split


def model_metadata(model: ChurnModel, split: DataFrame) -> DataFrame:
    """M2: one row of training facts; the counts come from one aggregate."""
    counts = split.agg(F.sum((~F.col("is_test")).cast("long")).alias("n_train"), F.sum(F.col("is_test").cast("long")).alias("n_test"))
    m = model.meta
    return counts.select(
        F.lit(json.dumps(m.get("numeric_cols", model.numeric))).alias("numeric_cols"),
        F.lit(json.dumps(m.get("categorical_cols", model.categorical))).alias("categorical_cols"),
        F.lit(len(model.names)).alias("n_features"),
        F.lit(m.get("random_state", SEED)).alias("random_state"),
        F.lit(float(m.get("test_size", TEST_SIZE))).alias("test_size"),
        "n_train", "n_test",
        F.lit(m.get("max_depth", MAX_DEPTH)).alias("max_depth"),
        F.lit(m.get("min_samples_leaf", MIN_SAMPLES_LEAF)).alias("min_samples_leaf"),
    )


# ---------------------------------------------------------------------------
# Drivers
# ---------------------------------------------------------------------------
def rank_drivers(imp: DataFrame) -> DataFrame:
    """Rank 1..n by importance descending, feature ascending on ties (feature-count rows)."""
    w = Window.orderBy(F.desc("importance"), F.asc("feature"))
    return imp.withColumn("rank", F.row_number().over(w).cast("int"))


def feature_importance(spark: SparkSession, model: ChurnModel) -> DataFrame:
    """(feature, importance, rank) from the tree's importances."""
    imps = model.importances()
    if len(imps) != len(model.names):
        raise ValueError(f"the model has {len(model.names)} feature names and {len(imps)} importances")
    rows = [(n, float(v), 0) for n, v in zip(model.names, imps)]
    return rank_drivers(spark.createDataFrame(rows, DRIVER_SCHEMA).drop("rank"))


def top_drivers(drivers: DataFrame, n: int = TOP_DRIVERS) -> DataFrame:
    """First n drivers, importance rounded to 6 places."""
    if not 1 <= n <= 50:
        raise ValueError("top_n must be within 1..50")
    return drivers.orderBy("rank").limit(n).select("feature", round_exact("importance", 6).alias("importance"), "rank")


def driver_display(drivers: DataFrame) -> DataFrame:
    """D3: percent (2 dp), bar width against max(importance, 0.0001), top-3 flag, short name."""
    top = F.greatest(F.max("importance").over(Window.partitionBy()), F.lit(MIN_BAR_SCALE))  # over the shown rows
    return drivers.select(
        "rank", "feature",
        round_exact(F.col("importance") * F.lit(100.0), 2, ties="up").alias("importance_pct"),
        (F.col("importance") / top * F.lit(100.0)).alias("bar_width_pct"),
        (F.col("rank") <= 3).alias("top_driver"),
        shorten("feature").alias("short_name"),
    )


def root_gini_gain(df: DataFrame, categorical: list[str], label: str = LABEL_COL, weighted: bool = True) -> DataFrame:
    """Gini decrease of splitting the root on each one-hot slot (column = value).

    Categoricals are unpivoted to (column, value), counted by (column, value) with
    map-side partial aggregation (at most #columns x #categories groups), and compared
    with the per-column totals.  ``weighted`` applies balanced class weights.
    """
    long = df.select(F.col(label).cast("int").alias("_y"), *[F.col(c).cast("string") for c in categorical]).unpivot(
        ["_y"], categorical, "column", "value")
    counts = long.groupBy("column", "value").agg(
        F.sum((F.col("_y") == 1).cast("long")).alias("c1"), F.sum((F.col("_y") == 0).cast("long")).alias("c0"))
    per_col = Window.partitionBy("column")  # the categories of one column
    totals = counts.withColumns({"t1": F.sum("c1").over(per_col), "t0": F.sum("c0").over(per_col)})
    return totals.filter(F.col("value").isNotNull()).select(
        F.concat(F.col("column"), F.lit("_"), F.col("value")).alias("feature"),
        _split_gain(weighted).alias("gain"),
    )


def _split_gain(weighted: bool) -> Column:
    """Gini decrease of a split that puts c1 and c0 of t1 and t0 rows (label 1 and 0) on one side."""
    n = F.col("t1") + F.col("t0")
    if weighted:
        w1 = F.when(F.col("t1") > 0, n / (2.0 * F.col("t1"))).otherwise(F.lit(0.0))
        w0 = F.when(F.col("t0") > 0, n / (2.0 * F.col("t0"))).otherwise(F.lit(0.0))
    else:
        w1 = w0 = F.lit(1.0)

    def gini(a1, a0):
        s = a1 + a0
        return F.when(s > 0, 1.0 - (a1 / s) * (a1 / s) - (a0 / s) * (a0 / s)).otherwise(F.lit(0.0))

    l1, l0 = F.col("c1") * w1, F.col("c0") * w0
    r1, r0 = (F.col("t1") - F.col("c1")) * w1, (F.col("t0") - F.col("c0")) * w0
    p1, p0 = F.col("t1") * w1, F.col("t0") * w0
    tot = p1 + p0
    gain = gini(p1, p0) - ((l1 + l0) / tot) * gini(l1, l0) - ((r1 + r0) / tot) * gini(r1, r0)
    return F.when(tot > 0, gain).otherwise(F.lit(0.0))


def numeric_splits(df: DataFrame, numeric: list[str], label: str = LABEL_COL, weighted: bool = True, min_rows: int = 1) -> DataFrame:
    """D4 for numbers: the best threshold of each column for splitting the root, one row per column.

    Each column's distinct values are counted by class, swept in order with running class counts
    (``ordered.prefix_sums``), and every midpoint of neighbouring values is a candidate, if both
    sides keep ``min_rows`` rows.  Gains equal to 12 places count as ties; the lower threshold
    wins.  Null and NaN are left out of their column; a column without a candidate has no row.
    """
    y = F.col(label).cast("int")
    out = None
    for c in numeric:
        v = F.col(c).cast("double")
        counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(
            F.sum((y == 1).cast("long")).alias("c1"), F.sum((y == 0).cast("long")).alias("c0"))
        run = prefix_sums(counts, ["v"], ["c1", "c0"], next_cols=["v"])
        t1, t0 = (counts.agg(F.sum(k)).scalar() for k in ("c1", "c0"))
        cells = run.where(F.col("next_v").isNotNull()).select(
            ((F.col("v") + F.col("next_v")) / 2.0).alias("threshold"), F.col("cum_c1").alias("c1"), F.col("cum_c0").alias("c0"), t1.alias("t1"), t0.alias("t0"))
        rated = cells.withColumn("gain", _split_gain(weighted)).where(
            (F.col("c1") + F.col("c0") >= min_rows) & (F.col("t1") + F.col("t0") - F.col("c1") - F.col("c0") >= min_rows))
        order = F.struct(F.round("gain", 12), (-F.col("threshold")).alias("low"))
        best = rated.agg(F.max_by(F.struct("threshold", "gain", (F.col("c1") + F.col("c0")).alias("n_left"),
                                           (F.col("t1") + F.col("t0") - F.col("c1") - F.col("c0")).alias("n_right")), order).alias("b"))
        row = best.where(F.col("b").isNotNull()).select(F.lit(c).alias("feature"), "b.*")
        out = row if out is None else out.unionByName(row)
    if out is None:
        return df.sparkSession.createDataFrame([], "feature string, threshold double, gain double, n_left long, n_right long")
    return out


def gain_drivers(gains: DataFrame) -> DataFrame:
    """Normalised gains ranked like D1 (importance = gain / sum of gains)."""
    share = F.col("gain") / F.sum("gain").over(Window.partitionBy())  # over the slot rows
    return rank_drivers(gains.select("feature", F.when(F.col("gain") > 0, share).otherwise(F.lit(0.0)).alias("importance")))


# ---------------------------------------------------------------------------
# E6
# ---------------------------------------------------------------------------
def evaluate_model(spark: SparkSession, model: ChurnModel, split: DataFrame, label: str = LABEL_COL) -> dict:
    """Score the held-out rows once (persisted), then E1-E5 and D1."""
    test = split.filter(F.col("is_test")).drop("is_test")
    scored = model.transform(test).select(F.col(label).alias("label"), F.col("churn_probability").alias("score"),
                                          "prediction").persist()
    return {
        "confusion_matrix": E.confusion_matrix(scored),
        "metrics": E.binary_metrics(scored),
        "roc_auc": E.roc_auc(scored),
        "roc_curve": E.roc_curve(scored),
        "report": E.classification_report(scored),
        "drivers": feature_importance(spark, model),
        "scored": scored,
    }
