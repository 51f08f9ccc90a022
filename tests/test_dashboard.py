"""Dashboard operators: tenure bands, filters, paging."""

from pyspark.sql import functions as F

from churnlens.functions.columns import risk_level, tenure_band
from churnlens.operators import dashboard as Q


def test_tenure_band_edges(spark):
    vals = [0, 12, 13, 24, 25, 48, 49, 72, 73, None, -1]
    df = spark.createDataFrame([(v,) for v in vals], "tenure int")
    got = [r[0] for r in df.select(tenure_band("tenure")).collect()]
    assert got == ["0-12", "0-12", "13-24", "13-24", "25-48", "25-48", "49-72", "49-72", None, None, None]


def test_risk_edges(spark):
    vals = [0.0, 0.3299, 0.33, 0.6599, 0.66, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    assert [r[0] for r in df.select(risk_level("p")).collect()] == ["Low", "Low", "Medium", "Medium", "High", "High"]


def _scored(spark):
    rows = [("a.b", "One year", "Yes", "High", "New Value High-Risk Customers", 1),
            ("axb", "Two year", "No", "Low", "Loyal Value Low-Risk Customers", 2),
            ("A*B", "One year", "No", "Medium", None, 3),
            ("[x]", "Month-to-month", "Yes", "High", "Steady Mid-Spend High-Risk Customers", 4),
            (None, "One year", "No", "Low", "x", 5)]
    return spark.createDataFrame(rows, "customer_id string, contract string, churn string, risk_level string, "
                                       "persona_name string, tenure int")


def test_search_is_regex_case_insensitive_and_null_safe(spark):
    df = _scored(spark)
    ids = lambda d: sorted(r[0] for r in d.select("customer_id").collect())
    assert ids(Q.search_customers(df, "a.b")) == ["A*B", "a.b", "axb"]
    assert ids(Q.search_customers(df, "a.b", literal=True)) == ["a.b"]
    assert ids(Q.search_customers(df, r"\[")) == ["[x]"]
    assert Q.search_customers(df, "").count() == 5


def test_filters_combine(spark):
    df = _scored(spark)
    assert Q.filter_churn(df, " yes ").count() == 2
    assert Q.filter_churn(df, "maybe").count() == 5  # ignored, as the reference does
    assert Q.filter_risk(df, "HIGH ").count() == 2
    assert Q.filter_persona(df, "high-risk").count() == 2
    assert Q.filter_customers(df, contract="One year", churn="no").count() == 2


def test_paging_and_page_count(spark):
    df = _scored(spark).filter(F.col("customer_id").isNotNull())
    rows, total = Q.list_customers(df, page=2, page_size=2)
    assert [r["customer_id"] for r in rows.collect()] == ["a.b", "axb"]  # binary order: A*B, [x], a.b, axb
    assert total.first()["total"] == 4
    past, _ = Q.list_customers(df, page=9, page_size=2)
    assert past.count() == 0
    nxt = Q.list_customers_after(df, "[x]", 2)
    assert [r["customer_id"] for r in nxt.collect()] == ["a.b", "axb"]
    pc = spark.range(1).select(Q.page_count(F.lit(0), 20).alias("a"), Q.page_count(F.lit(41), 20).alias("b")).first()
    assert (pc.a, pc.b) == (1, 3)


def test_churn_distribution_keeps_zero_class(spark):
    df = spark.createDataFrame([(1,), (1,)], "churn int")
    got = [(r.label, r.value) for r in Q.churn_distribution(df).orderBy("position").collect()]
    assert got == [("No Churn", 0), ("Churn", 2)]


def test_invalid_regex_is_a_clear_error(spark):
    import pytest

    with pytest.raises(ValueError, match="Invalid search pattern"):
        Q.search_customers(_scored(spark), "a[")
    with pytest.raises(ValueError, match="Invalid search pattern"):
        Q.filter_persona(_scored(spark), "(unclosed")


def test_key_set_pages_keep_repeated_ids(spark):
    rows = [(None, 1), (None, 2), ("a", 1), ("b", 1), ("b", 2), ("b", 2), ("c", 1)]
    df = spark.createDataFrame(rows, "customer_id string, tenure int")
    got, last, shown = [], None, 0
    while page := [tuple(r) for r in Q.list_customers_after(df, last, 2, shown).collect()]:
        got += page
        last = page[-1][0]
        shown = sum(1 for r in got if r[0] == last)
    assert got == rows
