"""Dashboard queries (Q1-Q15) over a cleaned or scored customer table.

Filters are plain column predicates, so equality filters (Q10-Q12) reach the parquet
scan of a materialised scored table as pushed filters; regex filters (Q9, Q13) run
right above the scan.  Aggregates are single hash aggregates with map-side partial
aggregation, so a hot contract or band costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.columns import TENURE_LABELS, safe_ratio, tenure_band, tenure_band_index
from churnlens.functions.rounding import round_exact
from churnlens.sources.schema import ID_COL, LABEL_COL, MONTHLY, TENURE


def _is_churn(label_col: str, df: DataFrame | None = None) -> Column:
    """Label as 0/1 whether the table holds 0/1 or Yes/No."""
    c = F.col(label_col)
    if df is not None and dict(df.dtypes).get(label_col) in ("int", "bigint", "smallint", "tinyint"):
        return c
    return F.when(c.cast("string").isin("1", "Yes"), 1).when(c.cast("string").isin("0", "No"), 0)


def kpi_summary(df: DataFrame, persona_count: int = 0, label_col: str = LABEL_COL) -> DataFrame:
    """Q1: one row of dashboard KPIs; high-risk count is 0 when the table is unscored."""
    high = F.sum((F.col("risk_level") == "High").cast("long")) if "risk_level" in df.columns else F.lit(0)
    agg = df.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.coalesce(F.sum(_is_churn(label_col, df)), F.lit(0)).cast("long").alias("churned_customers"),
        F.coalesce(high, F.lit(0)).cast("long").alias("high_risk_count"),
        F.avg(TENURE).alias("avg_tenure"),
        F.avg(MONTHLY).alias("avg_monthly_charges"),
    )
    return agg.select(
        "total_customers",
        "churned_customers",
        safe_ratio("churned_customers", "total_customers").alias("churn_rate"),
        "high_risk_count",
        F.lit(int(persona_count)).alias("persona_count"),
        "avg_tenure",
        "avg_monthly_charges",
    )


def churn_distribution(df: DataFrame, label_col: str = LABEL_COL) -> DataFrame:
    """Q2: "No Churn" then "Churn" with counts; a missing class still shows 0."""
    y = _is_churn(label_col, df)
    agg = df.agg(
        F.coalesce(F.sum((y == 0).cast("long")), F.lit(0)).alias("n0"),
        F.coalesce(F.sum((y == 1).cast("long")), F.lit(0)).alias("n1"),
    )
    rows = F.explode(F.array(
        F.struct(F.lit(0).alias("position"), F.lit("No Churn").alias("label"), F.col("n0").alias("value")),
        F.struct(F.lit(1).alias("position"), F.lit("Churn").alias("label"), F.col("n1").alias("value")),
    ))
    return agg.select(rows.alias("r")).select("r.label", "r.value", "r.position")


def churn_by_contract(df: DataFrame, label_col: str = LABEL_COL, contract_col: str = "contract") -> DataFrame:
    """Q3: churn rate (4 dp) and count per contract, null contracts dropped, by key."""
    out = (
        df.filter(F.col(contract_col).isNotNull())
        .groupBy(F.col(contract_col).alias("contract"))
        .agg(F.avg(_is_churn(label_col, df)).alias("_rate"), F.count(F.lit(1)).alias("count"))
    )
    return out.select("contract", round_exact("_rate", 4).alias("churn_rate"), "count", "_rate")


def churn_by_contract_ranked(df: DataFrame, label_col: str = LABEL_COL) -> DataFrame:
    """Q4: as Q3, highest (unrounded) rate first, contract as tie-break."""
    return churn_by_contract(df, label_col).orderBy(F.desc("_rate"), "contract").drop("_rate")


def with_tenure_band(df: DataFrame, tenure_col: str = TENURE) -> DataFrame:
    """Q5: ``tenure_bin`` text and its order index (null outside the bands)."""
    return df.withColumns({"tenure_bin": tenure_band(tenure_col), "tenure_bin_index": tenure_band_index(tenure_col)})


def churn_by_tenure(df: DataFrame, label_col: str = LABEL_COL, tenure_col: str = TENURE) -> DataFrame:
    """Q6: churn rate (4 dp) and count per tenure band, in band order; empty bands absent."""
    banded = df.select(tenure_band_index(tenure_col).alias("tenure_bin_index"), _is_churn(label_col, df).alias("_y"))
    agg = (
        banded.filter(F.col("tenure_bin_index").isNotNull())
        .groupBy("tenure_bin_index")
        .agg(F.avg("_y").alias("_rate"), F.count(F.lit(1)).alias("count"))
    )
    labels = F.array(*[F.lit(x) for x in TENURE_LABELS])
    return agg.select(
        F.element_at(labels, F.col("tenure_bin_index") + 1).alias("tenure_bin"),
        round_exact("_rate", 4).alias("churn_rate"),
        "count",
        "tenure_bin_index",
    ).orderBy("tenure_bin_index")


def persona_distribution(profiles: DataFrame) -> DataFrame:
    """Q7: persona, count, churn rate (4 dp) from the profile table."""
    return profiles.select(
        F.col("persona_name").alias("persona"), "count", round_exact("churn_rate", 4).alias("churn_rate"), "cluster_id"
    ).orderBy("cluster_id")


def percent_of_rate(rate) -> Column:
    """Q8: rate x 100 rounded to 1 dp as the UI shows it (ties away from zero)."""
    rate = F.col(rate) if isinstance(rate, str) else rate
    return round_exact(rate * F.lit(100.0), 1, ties="up")


def share_of_total(df: DataFrame, value_col: str, out: str = "share") -> DataFrame:
    """Q8: each slice's share of the whole (for small chart series only)."""
    return df.withColumn(out, F.col(value_col) / F.sum(value_col).over(Window.partitionBy()))


# ---------------------------------------------------------------------------
# Customer listing (Q9-Q15)
# ---------------------------------------------------------------------------
def validate_regex(spark, pattern: str) -> str:
    """Fail early, naming the pattern, when the (Java) regex does not compile.

    Runs the pattern once against a one-row literal plan, so no table is read.
    """
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
    except Exception as e:  # noqa: BLE001 - Spark wraps the PatternSyntaxException
        raise ValueError(f"Invalid search pattern {pattern!r}: {str(e).splitlines()[0]}") from None
    return pattern


def search_customers(df: DataFrame, text: str | None, literal: bool = False, id_col: str = ID_COL) -> DataFrame:
    """Q9: case-insensitive regex (or literal) match on the id; empty text keeps all."""
    if not text:
        return df
    if literal:
        return df.filter(F.lower(F.col(id_col)).contains(text.lower()))
    return df.filter(F.col(id_col).rlike(validate_regex(df.sparkSession, "(?iu)" + text)))


def filter_contract(df: DataFrame, contract: str | None) -> DataFrame:
    """Q10: exact equality (pushed into the scan)."""
    return df.filter(F.col("contract") == contract) if contract else df


def filter_churn(df: DataFrame, churn: str | None) -> DataFrame:
    """Q11: trimmed + capitalised; applied only when it reads Yes or No."""
    if not churn:
        return df
    label = churn.strip().capitalize()
    return df.filter(F.col(LABEL_COL) == label) if label in ("Yes", "No") else df


def filter_risk(df: DataFrame, risk_level: str | None) -> DataFrame:
    """Q12: equality on the risk level, the given value in any case (pushed into the scan)."""
    if not risk_level:
        return df
    return df.filter(F.col("risk_level") == risk_level.strip().capitalize())


def filter_persona(df: DataFrame, persona: str | None) -> DataFrame:
    """Q13: case-insensitive regex on the persona name; null never matches."""
    if not persona:
        return df
    return df.filter(F.col("persona_name").rlike(validate_regex(df.sparkSession, "(?iu)" + persona)))


def filter_customers(df: DataFrame, search: str = "", contract=None, churn=None, risk_level=None, persona=None,
                     literal: bool = False) -> DataFrame:
    """Q9-Q13 combined by AND."""
    out = search_customers(df, search, literal)
    out = filter_contract(out, contract)
    out = filter_churn(out, churn)
    out = filter_risk(out, risk_level)
    return filter_persona(out, persona)


LISTING_COLUMNS = ["customer_id", "tenure", "contract", "monthly_charges", "internet_service", "churn",
                   "risk_level", "persona_name", "cluster_id", "churn_probability"]


def list_customers(df: DataFrame, page: int = 1, page_size: int = 20, **filters) -> tuple[DataFrame, DataFrame]:
    """Q14: (page rows, one-row total) for the filtered table ordered by id.

    The page is a top-k (``offset + limit`` on a sort, planned as
    TakeOrderedAndProject), so no full sort runs; use ``list_customers_after`` for
    deep pages.
    """
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= page_size <= 100:
        raise ValueError("page_size must be within 1..100")
    view = filter_customers(df, **filters)
    cols = [c for c in LISTING_COLUMNS if c in view.columns]
    rows = view.select(*cols).orderBy(ID_COL, *[c for c in cols if c != ID_COL]).offset((page - 1) * page_size).limit(page_size)
    total = view.agg(F.count(F.lit(1)).alias("total"))
    return rows, total


def list_customers_after(df: DataFrame, last_id: str | None, page_size: int = 20, shown: int = 0, **filters) -> DataFrame:
    """Key-set page: the next ``page_size`` rows after ``last_id``, null ids first.

    Where an id can repeat, ``shown`` tells how many rows of ``last_id`` were shown so far
    (with ``last_id=None``: of the null ids); rows of one id stand in order of their columns.
    """
    view = filter_customers(df, **filters)
    if last_id is not None:
        view = view.filter(F.col(ID_COL) >= last_id if shown else F.col(ID_COL) > last_id)
    cols = [c for c in LISTING_COLUMNS if c in view.columns]
    page = view.select(*cols).orderBy(ID_COL, *[c for c in cols if c != ID_COL])
    return (page.offset(shown) if shown else page).limit(page_size)


def page_count(total, page_size: int) -> Column:
    """Q15: max(1, ceil(total / size))."""
    total = F.col(total) if isinstance(total, str) else total
    return F.greatest(F.lit(1), F.ceil(total / F.lit(page_size))).cast("long")
