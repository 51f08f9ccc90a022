"""Hold-out evaluation (E1-E5) on a scored table (label 0/1, score, predicted class).

Every metric is one aggregate or a group-by-score followed by exact running sums
(``ordered.prefix_sums``); nothing is collected and no window runs without a
partition over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.ordered import prefix_sums

CLASS_NAMES = ["No Churn", "Churn"]  # fixed: report row names of class 0 and 1


def _div(num, den):
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row (tn, fp, fn, tp) = [[TN, FP], [FN, TP]]; absent cells are 0."""
    y, p = F.col(label), F.col(pred)

    def cell(a, b):
        return F.coalesce(F.sum(((y == a) & (p == b)).cast("long")), F.lit(0)).alias

    return df.agg(cell(0, 0)("tn"), cell(0, 1)("fp"), cell(1, 0)("fn"), cell(1, 1)("tp"))


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 (0.0 when a denominator is 0)."""
    cm = confusion_matrix(df, label, pred)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cm.select(
        _div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _div(tp, tp + fp).alias("precision"),
        _div(tp, tp + fn).alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score (map-side combined)."""
    y = F.col(label)
    return df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum((y == 1).cast("long")).alias("pos"), F.sum((y == 0).cast("long")).alias("neg")
    )


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", n_partitions: int | None = None,
              drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, descending, plus the (0, 0) start at +inf.

    With ``drop_intermediate`` (the reference's default) a point is left out when its
    step (negatives, positives at that score) equals the next point's step, i.e. it lies
    inside a straight run; the first and last points always stay.  Running counts and
    the next point's step come from one range-partitioned pass (``prefix_sums``).
    """
    counts = score_counts(df, label, score)
    run = prefix_sums(counts, [F.col("threshold").desc()], ["pos", "neg"], n_partitions,
                      next_cols=["pos", "neg"] if drop_intermediate else None)
    P = counts.agg(F.sum("pos")).scalar()  # scalar subqueries, not joins
    N = counts.agg(F.sum("neg")).scalar()
    if drop_intermediate:
        first = (F.col("cum_pos") + F.col("cum_neg")) == (F.col("pos") + F.col("neg"))
        last = F.col("next_pos").isNull()
        bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        run = run.filter(first | last | bend)
    curve = run.select("threshold", _div(F.col("cum_neg"), N).alias("fpr"), _div(F.col("cum_pos"), P).alias("tpr"))
    start = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(curve)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", n_partitions: int | None = None) -> DataFrame:
    """Exact area under the ROC curve, tied scores counting one half (Mann-Whitney)."""
    counts = score_counts(df, label, score)
    run = prefix_sums(counts, [F.col("threshold").asc()], ["neg"], n_partitions)
    # negatives strictly below this score, plus half of the tied negatives
    # (counted twice, in wide decimals: products of counts outgrow a long)
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("pos", "neg", "cum_neg")}
    pairs = wide["pos"] * (wide["cum_neg"] * 2 - wide["neg"]).cast("decimal(19,0)")
    agg = run.agg(F.sum(pairs).alias("u"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(None).cast("double"))
                      .otherwise(F.col("u").cast("double") / (F.col("P").cast("double") * F.col("N") * 2)).alias("roc_auc"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """E5: per class precision / recall / F1 / support, accuracy, macro and weighted averages."""
    cm = confusion_matrix(df, label, pred)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def cls(name, t, f_pos, f_neg, support, order):
        prec, rec = _div(t, t + f_pos), _div(t, t + f_neg)
        return F.struct(
            F.lit(order).alias("position"), F.lit(name).alias("label"), prec.alias("precision"), rec.alias("recall"),
            _div(2 * t, 2 * t + f_pos + f_neg).alias("f1"), support.cast("long").alias("support"),
        )

    c0 = cls(CLASS_NAMES[0], tn, fn, fp, tn + fp, 0)
    c1 = cls(CLASS_NAMES[1], tp, fp, fn, tp + fn, 1)
    per = cm.select(c0.alias("a"), c1.alias("b"), n.alias("n"), _div(tp + tn, n).alias("acc"))

    def avg_row(name, order, wa, wb):
        def mix(field):
            return (F.col(f"a.{field}") * wa + F.col(f"b.{field}") * wb)
        return F.struct(F.lit(order).alias("position"), F.lit(name).alias("label"), mix("precision").alias("precision"),
                        mix("recall").alias("recall"), mix("f1").alias("f1"), F.col("n").cast("long").alias("support"))

    w_a = _div(F.col("a.support"), F.col("n"))
    w_b = _div(F.col("b.support"), F.col("n"))
    acc = F.struct(F.lit(2).alias("position"), F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"), F.col("n").cast("long").alias("support"))
    rows = F.array(F.col("a"), F.col("b"), acc, avg_row("macro avg", 3, F.lit(0.5), F.lit(0.5)),
                   avg_row("weighted avg", 4, w_a, w_b))
    return per.select(F.explode(rows).alias("r")).select("r.*")
