"""Schemas, column roles and the fixed value domains of the subscriber table."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical (snake_case) names used by every operator.
ID_COL = "customer_id"
KEY_COL = "cust_key"
LABEL_COL = "churn"
TENURE = "tenure"
MONTHLY = "monthly_charges"
TOTAL = "total_charges"
SENIOR = "senior_citizen"

# Columns that are identifiers, never features.
ID_COLS = (KEY_COL, ID_COL)

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (column names of its CSV and
# the category domains offered by its input form).
# ---------------------------------------------------------------------------
REFERENCE_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
    "MonthlyCharges", "TotalCharges", "Churn",
]
YES_NO = ["Yes", "No"]
YES_NO_PHONE = ["Yes", "No", "No phone service"]
YES_NO_INTERNET = ["Yes", "No", "No internet service"]
GENDERS = ["Female", "Male"]
INTERNET_SERVICES = ["DSL", "Fiber optic", "No"]
CONTRACTS = ["Month-to-month", "One year", "Two year"]
PAYMENT_METHODS = [
    "Electronic check",
    "Mailed check",
    "Bank transfer (automatic)",
    "Credit card (automatic)",
]
# Yes/No flags whose surrounding whitespace is trimmed on input.
TRIMMED_FLAGS = ["partner", "dependents", "phone_service", "paperless_billing"]
# ---------------------------------------------------------------------------


def _snake(name: str) -> str:
    if name == "customerID":
        return ID_COL
    out = []
    for i, ch in enumerate(name):
        if ch.isupper() and i and not name[i - 1].isupper():
            out.append("_")
        out.append(ch.lower())
    return "".join(out)


# Reference CSV name -> canonical name (customerID -> customer_id, MonthlyCharges -> monthly_charges).
RENAME = {c: _snake(c) for c in REFERENCE_COLUMNS}

_TYPES = {
    "senior_citizen": T.IntegerType(),
    "tenure": T.IntegerType(),
    "monthly_charges": T.DoubleType(),
    "total_charges": T.StringType(),  # raw text: blanks occur, parsed by V1
}

# Declared schema of the reference CSV (read without inference).
TELCO_CSV_SCHEMA = T.StructType(
    [T.StructField(c, _TYPES.get(RENAME[c], T.StringType()), True) for c in REFERENCE_COLUMNS]
)

# Value domains per canonical column (V3 rules).
DOMAINS = {
    "gender": GENDERS,
    "partner": YES_NO,
    "dependents": YES_NO,
    "phone_service": YES_NO,
    "paperless_billing": YES_NO,
    "multiple_lines": YES_NO_PHONE,
    "internet_service": INTERNET_SERVICES,
    "online_security": YES_NO_INTERNET,
    "online_backup": YES_NO_INTERNET,
    "device_protection": YES_NO_INTERNET,
    "tech_support": YES_NO_INTERNET,
    "streaming_tv": YES_NO_INTERNET,
    "streaming_movies": YES_NO_INTERNET,
    "contract": CONTRACTS,
    "payment_method": PAYMENT_METHODS,
}

# Range rules (column, low, high); None means unbounded.
RANGES = {
    "senior_citizen": (0, 1),
    "tenure": (0, None),
    "monthly_charges": (0, None),
    "total_charges": (0, None),
}

# Schema of the scored-customer table (R2), nullable model outputs.
SCORED_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("tenure", T.IntegerType(), True),
        T.StructField("contract", T.StringType(), True),
        T.StructField("monthly_charges", T.DoubleType(), True),
        T.StructField("internet_service", T.StringType(), True),
        T.StructField("churn", T.StringType(), True),
        T.StructField("risk_level", T.StringType(), True),
        T.StructField("persona_name", T.StringType(), True),
        T.StructField("cluster_id", T.IntegerType(), True),
        T.StructField("churn_probability", T.DoubleType(), True),
    ]
)

DRIVER_SCHEMA = T.StructType(
    [
        T.StructField("feature", T.StringType(), False),
        T.StructField("importance", T.DoubleType(), False),
        T.StructField("rank", T.IntegerType(), False),
    ]
)

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("cluster_id", T.IntegerType(), False),
        T.StructField("persona_name", T.StringType(), False),
        T.StructField("count", T.LongType(), False),
        T.StructField("pct_of_customers", T.DoubleType(), False),
        T.StructField("avg_tenure", T.DoubleType(), True),
        T.StructField("avg_monthly_charges", T.DoubleType(), True),
        T.StructField("avg_total_charges", T.DoubleType(), True),
        T.StructField("churn_rate", T.DoubleType(), True),
        T.StructField("characteristics", T.StringType(), True),
        T.StructField("top_contract", T.StringType(), True),
        T.StructField("top_internet", T.StringType(), True),
        T.StructField("top_payment", T.StringType(), True),
    ]
)
