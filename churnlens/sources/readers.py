"""Scans: the subscriber CSV / parquet and the driver's parquet tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from churnlens.functions.columns import parse_numeric
from churnlens.sources.schema import PROFILE_SCHEMA, RENAME, TELCO_CSV_SCHEMA


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Fail naming the missing and the found columns; no Spark job runs."""
    require_columns_list(list(df.columns), required)
    return df


def canonical_names(df: DataFrame) -> DataFrame:
    """Reference CSV names (customerID, MonthlyCharges, ...) to snake_case."""
    mapping = {c: RENAME[c] for c in df.columns if c in RENAME}
    return df.withColumnsRenamed(mapping) if mapping else df


def column_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """V7: the narrowest of bigint, double and string that holds every value of each text column.

    One aggregate over the table, one row back.  Blank and null values hold no type; a column
    of blanks alone is text.
    """
    if not columns:
        return {}
    aggs = []
    for n, c in enumerate(columns):
        t = F.trim(F.col(c))
        has = t.isNotNull() & (t != "")
        whole = t.rlike(r"^[+-]?[0-9]+$") & t.try_cast("bigint").isNotNull()
        aggs += [F.count_if(has).alias(f"n{n}"), F.count_if(has & whole).alias(f"i{n}"), F.count_if(has & parse_numeric(c).isNotNull()).alias(f"d{n}")]
    got = df.agg(*aggs).first()
    return {c: "string" if not got[f"n{n}"] or got[f"d{n}"] < got[f"n{n}"] else "bigint" if got[f"i{n}"] == got[f"n{n}"] else "double"
            for n, c in enumerate(columns)}


def with_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns as their types; blanks of a number column become null."""
    cast = {c: parse_numeric(c) if t == "double" else F.trim(F.col(c)).try_cast(t) for c, t in types.items() if t != "string"}
    return df.withColumns(cast) if cast else df


def load_customers(spark: SparkSession, path: str, fmt: str | None = None, extra_types: dict[str, str] | None = None) -> DataFrame:
    """The raw subscriber table; the reference's columns have a declared schema.

    CSV is read with a header and the reference's column types (TotalCharges as text);
    columns beyond these are text in the file and get the type that holds all their values
    (``column_types``: one aggregate, only if there are such columns and ``extra_types`` does not
    state theirs), so that a numeric extra is a numeric feature.  Parquet keeps its own schema.
    Columns are renamed to canonical names after the required-column check.
    """
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns  # header only, no data pass
        require_columns_list(header, TELCO_CSV_SCHEMA.fieldNames())
        known = {f.name: f for f in TELCO_CSV_SCHEMA.fields}
        ordered = [known.get(c) or StructField(c, StringType()) for c in header]
        df = spark.read.schema(StructType(ordered)).option("header", True).option("enforceSchema", False).csv(path)
        extras = [c for c in header if c not in known]
        stated = extra_types or {}
        df = with_types(df, {**{c: stated[c] for c in extras if c in stated}, **column_types(df, [c for c in extras if c not in stated])})
    else:
        df = spark.read.format(fmt).load(path)
        require_columns_list(canonical_names(df).columns, [RENAME.get(c, c) for c in TELCO_CSV_SCHEMA.fieldNames()])
    return canonical_names(df)


def require_columns_list(found: list[str], required: Iterable[str]) -> None:
    missing = [c for c in required if c not in found]
    if missing:
        raise ValueError(f"required columns absent: {', '.join(missing)} (table has: {', '.join(found)})")


def read_drivers(spark: SparkSession, path: str, top_n: int = 15, fmt: str = "parquet") -> DataFrame:
    """The first ``top_n`` drivers (1..50) by rank."""
    if not 1 <= top_n <= 50:
        raise ValueError("top_n must be within 1..50")
    df = spark.read.format(fmt).option("header", True).option("inferSchema", False).load(path)
    return df.select(
        F.col("feature").cast("string"), F.col("importance").cast("double"), F.col("rank").cast("int")
    ).orderBy("rank", "feature").limit(top_n)


def read_profiles(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Persona profiles with each served column cast to its type."""
    df = spark.read.format(fmt).option("header", True).load(path)
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in PROFILE_SCHEMA.fields]).orderBy("cluster_id")
