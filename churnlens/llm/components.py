"""Connected components of an edge table, on the cluster.

Alternates the large-star and small-star steps: every node's larger neighbours are linked
to its smallest one, then its smaller neighbours are.  Each round is two grouped
aggregations, written to the shared folder so that lineage stays short; labels reach the
smallest node of a component in a number of rounds logarithmic in its size.  Nothing is
collected but one count and one sum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import materialised


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v) edges; a hub's edges are never gathered in one place."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    if large:
        linked = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v), label the smallest node of its component."""
    now = materialised(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = materialised(_star(_star(now, large=True), large=False), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == seen:
            break
        seen = (state["n"], state["s"])
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
