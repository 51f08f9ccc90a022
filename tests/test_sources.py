"""The reference-shaped CSV is read with a declared schema and canonical names."""

import pytest
from pyspark.sql import functions as F

from churnlens.operators import quality as V
from churnlens.sources.readers import load_customers
from churnlens.sources.schema import REFERENCE_COLUMNS
from churnlens.sources.subscriber import subscribers

from conftest import SF_SMALL

def source():
    """Reference CSV name -> expression over the subscriber view (columns without a source get a fixed value)."""
    return {
    "customerID": F.col("customer_id"), "gender": F.lit("Female"), "SeniorCitizen": F.col("senior_citizen"),
    "Partner": F.concat(F.lit(" "), F.col("partner")), "Dependents": F.col("dependents"), "tenure": F.col("tenure"),
    "PhoneService": F.lit("Yes"), "MultipleLines": F.lit("No"), "InternetService": F.col("internet_service"),
    "OnlineSecurity": F.lit("No"), "OnlineBackup": F.lit("Yes"), "DeviceProtection": F.lit("No"),
    "TechSupport": F.lit("No"), "StreamingTV": F.lit("No"), "StreamingMovies": F.lit("No"),
    "Contract": F.col("contract"), "PaperlessBilling": F.col("paperless_billing"),
    "PaymentMethod": F.col("payment_method"), "MonthlyCharges": F.col("monthly_charges"),
    "TotalCharges": F.col("total_charges"), "Churn": F.col("churn"),
    }


def test_load_reference_csv(spark, tmp_path):
    view = subscribers(spark, SF_SMALL)
    path = str(tmp_path / "telco")
    cols = source()
    view.select(*[cols[c].alias(c) for c in REFERENCE_COLUMNS]).write.option("header", True).csv(path)
    df = load_customers(spark, path)
    assert "customer_id" in df.columns and "total_charges" in df.columns and "customerID" not in df.columns
    types = dict(df.dtypes)
    assert types["total_charges"] == "string" and types["tenure"] == "int" and types["monthly_charges"] == "double"
    assert df.count() == view.count()
    blank = view.filter(F.trim("total_charges") == "").count()
    assert V.clean(V.trim_flags(df)).count() == view.count() - blank
    assert V.trim_flags(df).filter(F.col("partner").startswith(" ")).count() == 0


def test_load_csv_missing_column(spark, tmp_path):
    path = str(tmp_path / "bad")
    spark.createDataFrame([("a", 1)], "customerID string, tenure int").write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="required columns absent"):
        load_customers(spark, path)
