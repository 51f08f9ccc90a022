"""Sinks (S3-S7): small result tables, the k search, metrics and the scored table.

Small tables (feature count, k or one row) are written as a single file; the scored
customer table is written partitioned and unsorted so every task writes its own
files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_small(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """One file for a table whose size is bounded (drivers, profiles, metrics)."""
    writer = df.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_drivers(drivers: DataFrame, path: str, fmt: str = "parquet") -> str:
    """S3: (feature, importance, rank) ordered by rank."""
    return write_small(drivers.select("feature", "importance", "rank").orderBy("rank"), path, fmt)


def write_profiles(profiles: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Persona profiles ordered by cluster id."""
    return write_small(profiles.orderBy("cluster_id"), path, fmt)


def write_k_search(search: DataFrame, chosen_k: int, path: str, k_in_use: int | None = None) -> str:
    """One JSON row per k (k, inertia, silhouette, chosen, k_in_use).

    ``chosen`` marks the search's best silhouette; ``k_in_use`` is the k of the final model,
    which may be fixed beforehand.
    """
    used = F.lit(chosen_k if k_in_use is None else k_in_use).cast("int")
    out = search.withColumns({"chosen": F.col("k") == F.lit(chosen_k), "k_in_use": used}).orderBy("k")
    return write_small(out, path, "json")


def write_metrics(metrics: DataFrame, path: str) -> str:
    """One JSON row of the hold-out evaluation."""
    return write_small(metrics, path, "json")


def write_scored(scored: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """The materialised scored table the dashboard queries read (filters push into it)."""
    writer = scored.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path
