"""Exact rounding / formatting matches Python on ties and near-ties."""

from pyspark.sql import functions as F

from churnlens.functions.rounding import format_fixed, format_percent, round_exact

VALUES = [12.25, 0.15, 2.675, 12.35, 0.125, 47.15, 1.005, 0.0, -2.5, -0.15, 99.95, 1e-7, 123456.785, 0.5, 1.5, 2.5]


def test_round_and_format_match_python(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x double")
    rows = df.select(
        "x",
        round_exact(F.col("x"), 1).alias("r1"), round_exact(F.col("x"), 2).alias("r2"), round_exact(F.col("x"), 4).alias("r4"),
        format_fixed(F.col("x"), 1).alias("f1"), format_fixed(F.col("x"), 2).alias("f2"),
        format_percent(F.col("x")).alias("p"),
    ).collect()
    for r in rows:
        x = r["x"]
        assert r["r1"] == round(x, 1), x
        assert r["r2"] == round(x, 2), x
        assert r["r4"] == round(x, 4), x
        assert r["f1"] == f"{x:.1f}" or (x < 0 and round(x, 1) == 0), x
        assert r["f2"] == f"{x:.2f}" or (x < 0 and round(x, 2) == 0), x
        assert r["p"] == f"{100 * x:.1f}%" or x < 0, x


def test_ties_up_mode_matches_javascript_to_fixed(spark):
    # JavaScript (12.25).toFixed(1) == "12.3": exact binary ties go up.
    df = spark.createDataFrame([(12.25,), (0.125,), (12.35,)], "x double")
    got = [r[0] for r in df.select(round_exact(F.col("x"), 1, ties="up")).collect()]
    assert got == [12.3, 0.1, 12.3]


def test_null_passes_through(spark):
    df = spark.createDataFrame([(None,)], "x double")
    r = df.select(round_exact(F.col("x"), 2).alias("a"), format_fixed(F.col("x"), 2).alias("b")).first()
    assert r["a"] is None and r["b"] is None
