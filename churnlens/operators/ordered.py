"""Exact running sums over a global order without a single-partition window.

``sum(x) OVER (ORDER BY k)`` with no PARTITION BY moves every row into one task.  Here the
rows are dealt to buckets by a pure expression of their key (bounds from one quantile
sketch, entered as literals), so every use of the frame sees the same buckets whatever the
cluster, the layout or a recomputed task.  A first aggregate gives the buckets' totals, the
running sums inside each bucket are one window, and the totals before a bucket enter as a
literal array.  The number of buckets follows from the number of rows alone.
"""

from __future__ import annotations

import re

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 1024  # bounds of the sketch; beyond ROWS_PER_BUCKET x MAX_BUCKETS rows the buckets grow


def _sort_key(c: Column | str) -> tuple[Column, bool]:
    """(key, is descending) of a column name or a sort order such as ``F.col("k").desc()``."""
    if isinstance(c, str):
        return F.col(c), False
    found = re.fullmatch(r"Column<'(.*) (ASC|DESC) NULLS (?:FIRST|LAST)'>", str(c))
    return (F.expr(found[1]), found[2] == "DESC") if found else (c, False)


def bucket_bounds(df: DataFrame, key: Column, n_buckets: int | None = None) -> list[float]:
    """Rising bounds that cut the rows into ``n_buckets`` parts of about the same size (one aggregate).

    Equal bounds fall together, so the parts are fewer where one key is frequent.
    """
    points = [i / MAX_BUCKETS for i in range(1, MAX_BUCKETS)] if n_buckets is None else [i / n_buckets for i in range(1, n_buckets)]
    value = key.cast("double")
    sketch = F.percentile_approx(F.when(~F.isnan(value), value), points, 10 * MAX_BUCKETS) if points else F.lit(None)
    got = df.agg(F.count(F.lit(1)).alias("n"), sketch.alias("q")).first()
    found = got["q"] or []
    if n_buckets is None:
        n = min(MAX_BUCKETS, -(-got["n"] // ROWS_PER_BUCKET))
        found = [found[round(i * MAX_BUCKETS / n) - 1] for i in range(1, n)] if found else []
    return sorted({float(b) for b in found if abs(b) != float("inf")})


def with_bucket(df: DataFrame, key: Column, bounds: list[float], out: str = "_bucket") -> DataFrame:
    """``out`` = number of bounds at or below the key (binary search); a null key is below all, NaN above all."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    inf = float("inf")
    value = F.coalesce(key.cast("double"), F.lit(-inf))
    tool = Bucketizer(splits=[-inf, *bounds, inf], inputCol="_key", outputCol=out)
    placed = tool.transform(df.withColumn("_key", F.when(F.isnan(value), F.lit(inf)).otherwise(value)))
    return placed.withColumn(out, F.col(out).cast("int")).drop("_key")


def prefix_sums(df: DataFrame, order_by: list[Column | str], sums: list[str], n_buckets: int | None = None,
                next_cols: list[str] | None = None) -> DataFrame:
    """Adds ``cum_<c>`` = sum of ``c`` over all rows up to and including this one.

    ``order_by`` is one number whose values are unique (ties would be summed in an arbitrary
    order), rising or as a descending sort order; nulls come first when rising.  With
    ``next_cols`` it also adds ``next_<c>``: the value of ``c`` in the following row of the
    whole order (null for the last row).  Output keeps every input column.

    Two aggregates run while the result is built (bounds, then bucket totals; the first one
    alone where one bucket holds all rows); each brings one row per bucket to the driver.
    """
    (sort,) = order_by
    key, falling = _sort_key(sort)
    order = key.desc() if falling else key.asc()
    next_cols = list(next_cols or [])
    bounds = bucket_bounds(df, key, n_buckets)
    placed = with_bucket(df, key, bounds)
    n = len(bounds) + 1
    before = {c: [0] * n for c in sums}
    after: list = [None] * n
    if bounds:
        aggs = [F.sum(c).alias(f"_tot_{c}") for c in sums]
        if next_cols:
            edge = F.max_by if falling else F.min_by
            # a null key is the first row of a rising order and the last of a falling one
            place = F.coalesce(key.cast("double"), F.lit(float("-inf")))
            aggs.append(edge(F.struct(*next_cols), place).alias("_first"))
        found = {r["_bucket"]: r for r in placed.groupBy("_bucket").agg(*aggs).collect()}  # one row per bucket
        walk = sorted(found, reverse=falling)
        for c in sums:
            total = 0
            for b in walk:
                before[c][b] = total
                total = total + (found[b][f"_tot_{c}"] or 0)
        for b, following in zip(walk, walk[1:]):
            after[b] = found[following]["_first"] if next_cols else None
    within = Window.partitionBy("_bucket").orderBy(order)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a bucket is one range; two ranges at least, so that the exchange stays one of ranges
    out = placed.repartitionByRange(max(2, n), "_bucket")
    types = dict(df.dtypes)
    cols = {}
    for c in sums:
        kind = "double" if types[c] in ("double", "float") else types[c] if types[c].startswith("decimal") else "bigint"
        start = F.element_at(F.array(*[F.lit(v).cast(kind) for v in before[c]]), F.col("_bucket") + 1)
        cols[f"cum_{c}"] = F.sum(c).over(running) + start
    if next_cols:
        is_last = F.lead(F.lit(1)).over(within).isNull()
        for c in next_cols:
            kind = types[c]
            following = F.element_at(F.array(*[F.lit(r[c] if r else None).cast(kind) for r in after]), F.col("_bucket") + 1)
            cols[f"next_{c}"] = F.when(is_last, following).otherwise(F.lead(c).over(within))
    return out.withColumns(cols).drop("_bucket")
