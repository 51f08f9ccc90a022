"""Column-level expressions (all built-in Spark functions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
RISK_HIGH = 0.66  # probability >= 0.66 -> "High"
RISK_MEDIUM = 0.33  # probability >= 0.33 -> "Medium", else "Low"
# Tenure bands (months): [0, 12], (12, 24], (24, 48], (48, 72]
TENURE_EDGES = [0, 12, 24, 48, 72]
TENURE_LABELS = ["0-12", "13-24", "25-48", "49-72"]
# ---------------------------------------------------------------------------

# Text accepted as a number (what a lenient numeric parser takes): optional sign,
# digits with an optional fraction or a bare fraction, optional exponent; or inf.
NUMBER_PATTERN = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_numeric(c) -> Column:
    """Text to double; anything unparsable (blank, '5d', null) becomes null.

    ``try_cast`` alone accepts Java literal suffixes ('5d' -> 5.0), so the text is
    first matched against a plain number pattern.
    """
    t = F.trim(_c(c).cast("string"))
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def risk_level(p) -> Column:
    p = _c(p)
    return (
        F.when(p >= RISK_HIGH, F.lit("High"))
        .when(p >= RISK_MEDIUM, F.lit("Medium"))
        .when(p.isNotNull(), F.lit("Low"))
    )


def tenure_band_index(t) -> Column:
    """0..3 for [0,12], (12,24], (24,48], (48,72]; null outside or for null."""
    t = _c(t)
    e = TENURE_EDGES
    expr = F.when((t >= e[0]) & (t <= e[1]), F.lit(0))
    for i in range(1, len(e) - 1):
        expr = expr.when((t > e[i]) & (t <= e[i + 1]), F.lit(i))
    return expr


def tenure_band(t) -> Column:
    idx = tenure_band_index(t)
    expr = None
    for i, label in enumerate(TENURE_LABELS):
        expr = (F.when if expr is None else expr.when)(idx == i, F.lit(label))
    return expr


def label_text(y) -> Column:
    """1/0 label to Yes/No."""
    y = _c(y)
    return F.when(y == 1, F.lit("Yes")).when(y == 0, F.lit("No"))


def prediction_label(pred) -> Column:
    pred = _c(pred)
    return F.when(pred == 1, F.lit("Churn")).otherwise(F.lit("No Churn"))


def shorten(name, keep: int = 20, limit: int = 22) -> Column:
    """Names longer than ``limit`` characters cut to ``keep`` plus an ellipsis."""
    name = _c(name)
    return F.when(F.length(name) > limit, F.concat(F.substring(name, 1, keep), F.lit("…"))).otherwise(name)


def safe_ratio(num, den, empty: float = 0.0) -> Column:
    num, den = _c(num), _c(den)
    return F.when(den == 0, F.lit(empty)).otherwise(num.cast("double") / den)
