"""Search by an index of character n-grams (Q9 ids, Q13 persona names).

``write_index`` stores one row per distinct value and n-gram of its folded text, in ranges of
(gram, value) so that a gram's rows lie together and a frequent gram spreads over files, and
the number of values of each gram.  A search takes the literal runs that every match must
hold, reads the postings of their rarest grams, keeps the values that have all of them, and
only then applies the regex.  The matching values, if few, are pushed into the scan of the
customer table; otherwise they are joined.

Patterns whose literals cannot be told plainly (anything but letters, digits, blanks, ``#_-``,
``.`` and ``|``), without a run of ``N`` literal characters, or whose rarest gram is that of more
than ``SHARE`` of the values take the plain scan, so the rows are those of the plain form always.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.operators import dashboard as Q
from churnlens.sources.schema import ID_COL

N = 3
#: Grams read for one alternative of a pattern.
MOST_GRAMS = 3
#: Share of the values above which a gram's postings do not narrow the search.
SHARE = 0.2
#: Matching values that are pushed into the scan as a filter; more are joined.
PUSHED = 1_000
ROWS_PER_RANGE = 4_000_000


def folded(text: Column) -> Column:
    """Lower case, where letters that match an ASCII one without regard to case are that one."""
    return F.lower(F.translate(text, "ſKıİ", "skii"))


def write_index(df: DataFrame, path: str, col: str = ID_COL, rows_per_range: int = ROWS_PER_RANGE) -> str:
    """``values``, ``postings`` (gram, value) and ``counts`` (gram, n) of the column's distinct values, nulls left out."""
    spark = df.sparkSession
    df.select(F.col(col).alias("value")).where("value IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{path}/values")
    values = spark.read.parquet(f"{path}/values").withColumn("f", folded(F.col("value")))
    size = values.agg(F.sum(F.greatest(F.length("f") - (N - 1), F.lit(0))).alias("n")).first()["n"] or 0
    grams = F.expr(f"array_distinct(transform(sequence(1, length(f) - {N - 1}), i -> substring(f, i, {N})))")
    postings = values.where(F.length("f") >= N).select(F.explode(grams).alias("gram"), "value")
    ranges = max(1, -(-size // rows_per_range))
    postings.repartitionByRange(ranges, "gram", "value").sortWithinPartitions("gram", "value").write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")
    return path


def required_grams(pattern: str, literal: bool = False) -> list[list[str]] | None:
    """The grams of each alternative that all its matches hold; None where a match may hold none."""
    if literal:
        ways = [[pattern]] if pattern.isascii() else []
    else:
        ways = [way.split(".") for way in pattern.split("|")] if re.fullmatch(r"[A-Za-z0-9 #_.|-]+", pattern) else []
    found = [sorted({run[i : i + N].lower() for run in runs for i in range(len(run) - N + 1)}) for runs in ways]
    return found if found and all(found) else None


def matching_values(spark, path: str, pattern: str, literal: bool = False) -> DataFrame | None:
    """(value) of the indexed values that match, or None where the index does not narrow the search."""
    ways = required_grams(pattern, literal)
    if ways is None:
        return None
    wanted = sorted({g for way in ways for g in way})  # of the pattern alone
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(wanted)).collect()}
    most = SHARE * spark.read.parquet(f"{path}/values").count()
    rare = [sorted(way, key=lambda g: (counts.get(g, 0), g))[:MOST_GRAMS] for way in ways]
    if any(counts.get(way[0], 0) > most for way in rare):
        return None
    postings = spark.read.parquet(f"{path}/postings")
    read = postings.where(F.col("gram").isin(sorted({g for way in rare for g in way})))
    has = [F.lit(True)] if not rare else []
    for way in rare:
        all_of = F.lit(True)
        for g in way:
            all_of = all_of & F.max(F.col("gram") == g)
        has.append(all_of)
    any_way = has[0]
    for h in has[1:]:
        any_way = any_way | h
    candidates = read.groupBy("value").agg(any_way.alias("has")).where("has").select("value")
    return Q.search_customers(candidates, pattern, literal, id_col="value")


def search(df: DataFrame, path: str, pattern: str | None, col: str = ID_COL, literal: bool = False) -> DataFrame:
    """Q9 / Q13 through the index at ``path``: the rows of ``search_customers`` (``filter_persona``) on ``col``."""
    if not pattern:
        return df
    found = matching_values(df.sparkSession, path, pattern, literal)
    if found is None:
        return Q.search_customers(df, pattern, literal, id_col=col)
    few = [r["value"] for r in found.limit(PUSHED + 1).collect()]  # bounded
    if len(few) <= PUSHED:
        return df.where(F.col(col).isin(few)) if few else df.where(F.lit(False))
    return df.join(found.withColumnRenamed("value", "_value"), F.col(col) == F.col("_value"), "left_semi")
