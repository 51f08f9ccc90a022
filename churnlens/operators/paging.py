"""Deep pages of a written listing (Q14) by a sparse rank index of its keys.

``write_listing`` lays the rows down in ranges of the listing's order, so that the key
statistics of the files tell where a key range lies.  ``write_directory`` counts the rows of
each key once (partial aggregation, so a hot key costs one row per task), writes the distinct
keys in ranges of their order and keeps about one key in ``every`` rows together with the
number of rows before it.  A page then reads the rows between two directory keys, however
deep it lies.  Ranges follow the row counts alone, one number per range reaches the driver.

A directory belongs to the table it was built from: for a filtered listing build one from the
filtered table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.operators.dashboard import LISTING_COLUMNS
from churnlens.session import shared_path
from churnlens.sources.schema import ID_COL

EVERY = 10_000
ROWS_PER_RANGE = 1_000_000


def _order(df: DataFrame, id_col: str) -> list[str]:
    """The listing's order: the id, then the other columns."""
    return [id_col, *[c for c in LISTING_COLUMNS if c in df.columns and c != id_col]]


def write_listing(df: DataFrame, path: str, id_col: str = ID_COL, rows_per_range: int = ROWS_PER_RANGE) -> str:
    """The listing columns in ranges of the listing's order; rows of a hot id are split by their other columns."""
    cols = _order(df, id_col)
    ranges = max(1, -(-df.count() // rows_per_range))
    df.select(*cols).repartitionByRange(ranges, *cols).sortWithinPartitions(*cols).write.mode("overwrite").parquet(path)
    return path


def write_directory(listing: DataFrame, path: str, every: int = EVERY, id_col: str = ID_COL, keys_per_range: int = ROWS_PER_RANGE) -> str:
    """(key, before): keys of the listing, one at least in any ``every`` rows of many keys, and the rows sorted before them."""
    spark = listing.sparkSession
    scratch = shared_path(spark, spark.sparkContext.applicationId, f"directory-{uuid.uuid4().hex[:12]}")
    listing.groupBy(F.col(id_col).alias("key")).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{scratch}/keys")
    keys = spark.read.parquet(f"{scratch}/keys")
    ranges = max(1, -(-keys.count() // keys_per_range))
    keys.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()).write.parquet(f"{scratch}/ranges")
    ranged = spark.read.schema(f"key {keys.schema['key'].dataType.simpleString()}, n long, range int").parquet(f"{scratch}/ranges")
    totals = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # one row per range
    starts, at = [], 0
    for r in range(ranges):
        starts.append(at)
        at += totals.get(r, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("range") + 1)
    within = Window.partitionBy("range").orderBy("key")
    placed = ranged.select("key", "range", (start + F.sum("n").over(within) - F.col("n")).alias("before"), F.lag("n").over(within).alias("last"))
    # the first key of a range, and each key that begins a new block of ``every`` rows
    block = F.floor(F.col("before") / every)
    kept = placed.where(F.col("last").isNull() | (block != F.floor((F.col("before") - F.col("last")) / every)))
    kept.select("key", "before").sortWithinPartitions("before").write.mode("overwrite").parquet(path)
    return path


def key_range(directory: DataFrame, offset: int, n: int) -> tuple:
    """(key, rows before it, key beyond or None): the rows of rank ``offset`` to ``offset + n`` lie between the keys."""
    low = directory.where(F.col("before") <= offset).agg(F.max_by("key", "before").alias("key"), F.max("before").alias("before")).first()
    high = directory.where(F.col("before") >= offset + n).agg(F.min_by("key", "before").alias("key")).first()
    return low["key"], low["before"] or 0, high["key"]


def page_at(listing: DataFrame, directory: DataFrame, page: int = 1, page_size: int = 20, id_col: str = ID_COL) -> DataFrame:
    """Q14: the page of the offset form, read from one key range (null ids come first, a page past the end is empty)."""
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= page_size <= 100:
        raise ValueError("page_size must be within 1..100")
    offset = (page - 1) * page_size
    low, before, high = key_range(directory, offset, page_size)
    key = F.col(id_col)
    view = listing
    if low is not None:
        view = view.where(key >= F.lit(low))
    if high is not None:
        view = view.where(key < F.lit(high)) if low is not None else view.where((key < F.lit(high)) | key.isNull())
    cols = _order(listing, id_col)
    return view.select(*[c for c in LISTING_COLUMNS if c in cols]).orderBy(*cols).offset(offset - before).limit(page_size)
