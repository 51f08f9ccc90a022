"""Cluster profiles and data-named personas.

C1 is one hash aggregate by cluster id with map-side partial aggregation (a cluster
holding a third of all rows is pre-aggregated in every map task).  Everything after
it works on k rows; windows without PARTITION BY below run over those k rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.rounding import format_fixed, format_percent, round_exact
from churnlens.sources.schema import LABEL_COL, MONTHLY, SENIOR, TENURE, TOTAL

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's: naming thresholds and the
# sentence templates of a profile.
# ---------------------------------------------------------------------------
NEW_BELOW = 0.7  # cluster tenure < 0.7 x global mean -> "New"
LOYAL_ABOVE = 1.3  # > 1.3 x global mean -> "Loyal", else "Steady"
HIGH_SPEND_ABOVE = 1.15  # monthly > 1.15 x global mean -> "High-Spend"
VALUE_BELOW = 0.85  # < 0.85 x global mean -> "Value", else "Mid-Spend"
HIGH_RISK_FROM = 0.40  # churn rate >= 0.40 -> "High-Risk"
LOW_RISK_UPTO = 0.15  # <= 0.15 -> "Low-Risk", else "Moderate-Risk"
NAME_SUFFIX = " Customers"
SEPARATOR = " | "
# "Avg tenure {:.1f} months" | "Avg monthly charges ${:.2f}" | "Most common contract: {}"
# | "Most common internet: {}" | "Churn rate {:.1%}" | "Senior citizens {:.1%}" | "Have partner {:.1%}"
HIGH_CHURN_DISPLAY = 0.3  # UI flags a persona with churn rate >= 0.3
# ---------------------------------------------------------------------------

def _whole():
    return Window.partitionBy()  # over the k profile rows


def _yes_share(c: str) -> Column:
    return F.avg((F.col(c) == "Yes").cast("double"))


def cluster_profiles(df: DataFrame, cluster_col: str = "cluster_id", label_col: str = LABEL_COL) -> DataFrame:
    """C1 + C2 + C3 + C4: one row per cluster, ordered by id, with name and text."""
    stats = df.groupBy(F.col(cluster_col).cast("int").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(TENURE).alias("avg_tenure"),
        F.avg(MONTHLY).alias("avg_monthly_charges"),
        F.avg(TOTAL).alias("avg_total_charges"),
        F.avg(F.col(label_col).cast("double")).alias("churn_rate"),
        F.avg(F.col(SENIOR).cast("double")).alias("pct_senior"),
        _yes_share("partner").alias("pct_partner"),
        _yes_share("dependents").alias("pct_dependents"),
        F.mode("contract", True).alias("top_contract"),
        F.mode("internet_service", True).alias("top_internet"),
        F.mode("payment_method", True).alias("top_payment"),
        _yes_share("paperless_billing").alias("pct_paperless"),
        F.sum(TENURE).alias("_sum_tenure"),
        F.count(TENURE).alias("_n_tenure"),
        F.sum(MONTHLY).alias("_sum_monthly"),
        F.count(MONTHLY).alias("_n_monthly"),
    )
    # Global means from the k partial sums: no second pass over the rows.
    with_global = stats.withColumns({
        "pct_of_customers": F.col("count") / F.sum("count").over(_whole()),
        "_g_tenure": F.sum("_sum_tenure").over(_whole()) / F.sum("_n_tenure").over(_whole()),
        "_g_monthly": F.sum("_sum_monthly").over(_whole()) / F.sum("_n_monthly").over(_whole()),
    })
    named = with_global.withColumns({
        "characteristics": characteristics(),
        "persona_name": persona_name(F.col("_g_tenure"), F.col("_g_monthly")),
    })
    out = disambiguate_names(named)
    return out.select(
        "cluster_id", "count", "pct_of_customers", "avg_tenure", "avg_monthly_charges", "avg_total_charges",
        "churn_rate", "pct_senior", "pct_partner", "pct_dependents", "top_contract", "top_internet",
        "top_payment", "pct_paperless", "characteristics", "persona_name",
    ).orderBy("cluster_id")


def characteristics() -> Column:
    """Seven statements joined by " | " (numbers rounded like Python's format)."""
    return F.concat_ws(
        SEPARATOR,
        F.concat(F.lit("Avg tenure "), format_fixed(F.col("avg_tenure"), 1), F.lit(" months")),
        F.concat(F.lit("Avg monthly charges $"), format_fixed(F.col("avg_monthly_charges"), 2)),
        F.concat(F.lit("Most common contract: "), F.col("top_contract")),
        F.concat(F.lit("Most common internet: "), F.col("top_internet")),
        F.concat(F.lit("Churn rate "), format_percent(F.col("churn_rate"))),
        F.concat(F.lit("Senior citizens "), format_percent(F.col("pct_senior"))),
        F.concat(F.lit("Have partner "), format_percent(F.col("pct_partner"))),
    )


def persona_name(global_tenure: Column, global_monthly: Column) -> Column:
    """Tenure, spend and risk words from the cluster's stats against global means."""
    t, m, r = F.col("avg_tenure"), F.col("avg_monthly_charges"), F.col("churn_rate")
    g_t = F.coalesce(global_tenure, t)
    g_m = F.coalesce(global_monthly, m)
    tenure_word = F.when(t < g_t * NEW_BELOW, "New").when(t > g_t * LOYAL_ABOVE, "Loyal").otherwise("Steady")
    spend_word = F.when(m > g_m * HIGH_SPEND_ABOVE, "High-Spend").when(m < g_m * VALUE_BELOW, "Value").otherwise("Mid-Spend")
    risk_word = F.when(r >= HIGH_RISK_FROM, "High-Risk").when(r <= LOW_RISK_UPTO, "Low-Risk").otherwise("Moderate-Risk")
    return F.concat(tenure_word, F.lit(" "), spend_word, F.lit(" "), risk_word, F.lit(NAME_SUFFIX))


def disambiguate_names(profiles: DataFrame) -> DataFrame:
    """C4: a name shared by several clusters gets " (C<id>)" appended."""
    dup = F.count(F.lit(1)).over(Window.partitionBy("persona_name")) > 1
    return profiles.withColumn(
        "persona_name",
        F.when(dup, F.concat(F.col("persona_name"), F.lit(" (C"), F.col("cluster_id").cast("string"), F.lit(")")))
        .otherwise(F.col("persona_name")),
    )


def persona_lookup(profiles: DataFrame) -> DataFrame:
    """The k-row table used as the broadcast side of attach_persona."""
    return profiles.select(
        "cluster_id", "persona_name", "characteristics", "count", "churn_rate", "avg_tenure", "avg_monthly_charges"
    )


def split_characteristics(profiles: DataFrame) -> DataFrame:
    """One row per statement, with its position."""
    parts = F.posexplode(F.split(F.col("characteristics"), r" \| "))
    return profiles.filter(F.col("characteristics") != "").select("cluster_id", parts.alias("position", "statement"))


def persona_display(profiles: DataFrame) -> DataFrame:
    """Churn and share in percent (1 dp, as the UI rounds), high-churn flag."""
    return profiles.select(
        "cluster_id",
        "persona_name",
        round_exact(F.col("churn_rate") * F.lit(100.0), 1, ties="up").alias("churn_pct"),
        round_exact(F.col("pct_of_customers") * F.lit(100.0), 1, ties="up").alias("share_pct"),
        (F.col("churn_rate") >= HIGH_CHURN_DISPLAY).alias("high_churn"),
    )
