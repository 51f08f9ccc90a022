"""The subscriber table derived from the driver's ``customer`` and ``orders`` tables.

No subscriber table ships with the test data, so one row per customer is derived:
order recency gives the churn label, order history gives tenure and charges, and
customer attributes give the categorical columns.  Money is summed as DECIMAL so the
result is exact and identical in every engine.

Scale: one partial + final aggregate of ``orders`` by customer key, joined to
``customer`` on the same key (the aggregate's hash partitioning is reused, so only
``customer`` is shuffled).  The latest order date is a scalar subquery that is a plain
max over the ``orders`` scan (no second shuffle of ``orders``), not a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.rounding import round_exact
from churnlens.sources.readers import read_table

SUBSCRIBER_COLUMNS = [
    "cust_key", "customer_id", "senior_citizen", "partner", "dependents",
    "paperless_billing", "contract", "internet_service", "payment_method",
    "tenure", "monthly_charges", "total_charges", "churn",
]


def order_history(orders: DataFrame) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.min(day).alias("first_order"),
        F.max(day).alias("last_order"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("tot"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("urgent"),
    )


def subscribers_from(customer: DataFrame, orders: DataFrame) -> DataFrame:
    o = order_history(orders)
    # latest order date: a scan-side max (partial max per task, no shuffle by customer)
    latest = orders.select(F.max(F.col("o_orderdate").cast("date"))).scalar()
    c = customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    j = c.join(o, c.c_custkey == o.k, "inner")

    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    days = F.datediff("last_order", "first_order")
    yes_no = lambda cond: F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))
    tenure = (
        F.when(key % 3 == 0, F.floor(days / F.lit(30.0)))
        .when(key % 3 == 1, F.floor(days / F.lit(60.0)))
        .otherwise(F.floor(days / F.lit(240.0)))
    ).cast("int")
    tot_double = F.col("tot").cast("double")
    return j.select(
        key.alias("cust_key"),
        F.col("c_name").alias("customer_id"),
        F.when(key % 6 == 0, 1).otherwise(0).cast("int").alias("senior_citizen"),
        yes_no(nation % 2 == 0).alias("partner"),
        yes_no(nation % 3 == 0).alias("dependents"),
        yes_no(F.col("urgent") > 0).alias("paperless_billing"),
        F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), F.lit("Month-to-month"))
        .when(F.col("c_mktsegment").isin("FURNITURE", "HOUSEHOLD"), F.lit("One year"))
        .otherwise(F.lit("Two year"))
        .alias("contract"),
        F.when(nation < 8, F.lit("DSL")).when(nation < 17, F.lit("Fiber optic")).otherwise(F.lit("No")).alias("internet_service"),
        F.when(nation % 4 == 0, F.lit("Electronic check"))
        .when(nation % 4 == 1, F.lit("Mailed check"))
        .when(nation % 4 == 2, F.lit("Bank transfer (automatic)"))
        .otherwise(F.lit("Credit card (automatic)"))
        .alias("payment_method"),
        tenure.alias("tenure"),
        round_exact(tot_double / F.col("n_orders") / F.lit(1000.0), 2).alias("monthly_charges"),
        F.when(F.col("c_acctbal") < 0, F.lit(" "))
        .otherwise(F.round(F.col("tot"), 0).cast("bigint").cast("string"))
        .alias("total_charges"),
        F.when(F.datediff(F.lit(latest), F.col("last_order")) > 180, F.lit("Yes")).otherwise(F.lit("No")).alias("churn"),
    )


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw subscriber rows (total_charges as text, churn as Yes/No)."""
    return subscribers_from(read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders"))
