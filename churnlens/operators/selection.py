"""Order statistics without a sort: exact n-th smallest values by repeated counting.

Two forms, each a few aggregates whose results are bounded whatever the number of rows:

* ``order_statistics``: numbers, by narrowing quantile sketches, until a wanted rank falls on a
  sketched value or few rows are left.
* ``smallest_keys``: hexadecimal keys, by histograms of their leading digits.  Each round
  counts the next four digits below the prefix that holds the wanted rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW_ROWS = 10_000  # rows or values that the last step may bring to the driver
DIGITS = 4  # hexadecimal digits counted in one round: 65,536 counts for a class
SPREAD = 0.002  # share of the rows on either side of a wanted rank that a sketch must cover


def order_statistics(long: DataFrame, wanted: dict[int, list[int]], totals: dict[int, int]) -> dict[tuple[int, int], float]:
    """Value at 0-based rank r of group i, for each (i, r) of ``wanted``; ``totals`` holds the groups' rows.

    ``long`` has rows (i, v) with neither nulls nor NaN.  A search keeps an open range of
    values, the rows at or below it and the rows inside; each round sketches two values of
    the inside around the rank, counts exactly on both sides of them, and either stops at
    one of them or goes on in a smaller range without them.
    """
    found: dict[tuple[int, int], float] = {}
    # group and rank -> (range's ends, or none; rows at or below the range, rows inside)
    searches: dict[tuple[int, int], tuple[float | None, float | None, int, int]] = {
        (i, r): (None, None, 0, totals[i]) for i, ranks in wanted.items() for r in ranks}

    def inside(i: int, lo: float | None, hi: float | None) -> Column:
        c = F.col("i") == i
        c = c if lo is None else c & (F.col("v") > lo)
        return c if hi is None else c & (F.col("v") < hi)

    while searches:
        few = {k: s for k, s in searches.items() if s[3] <= FEW_ROWS}
        many = {k: s for k, s in searches.items() if s[3] > FEW_ROWS}
        if few:
            keep = None
            for (i, _), (lo, hi, _, _) in few.items():
                c = inside(i, lo, hi)
                keep = c if keep is None else keep | c
            rows = long.where(keep).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).collect()  # FEW_ROWS a search at most
            for (i, r), (lo, hi, below, _) in few.items():
                at = below
                for row in sorted((x for x in rows if x["i"] == i), key=lambda x: x["v"]):
                    if (lo is None or row["v"] > lo) and (hi is None or row["v"] < hi):
                        at += row["n"]
                        if at > r:
                            found[i, r] = row["v"]
                            break
        searches = {}
        if many:
            sketches = []
            for n, ((i, r), (lo, hi, below, size)) in enumerate(many.items()):
                at = (r - below + 0.5) / size
                points = [max(0.0, at - SPREAD), min(1.0, at + SPREAD)]
                sketches.append(F.percentile_approx(F.when(inside(i, lo, hi), F.col("v")), points, 10_000).alias(f"q{n}"))
            near = long.agg(*sketches).first()
            sides = []
            for n, (i, _) in enumerate(many):
                own = F.col("i") == i
                for k, v in enumerate(near[f"q{n}"]):
                    sides += [F.count_if(own & (F.col("v") < v)).alias(f"n{n}_{k}"), F.count_if(own & (F.col("v") <= v)).alias(f"u{n}_{k}")]
            exact = long.agg(*sides).first()
            for n, ((i, r), (lo, hi, below, size)) in enumerate(many.items()):
                upto = below + size
                for k, v in enumerate(near[f"q{n}"]):
                    under, through = exact[f"n{n}_{k}"], exact[f"u{n}_{k}"]
                    if r < under:
                        hi, upto = v, under
                        break
                    if r < through:
                        found[i, r] = v
                        break
                    lo, below = v, through
                if (i, r) not in found:
                    searches[i, r] = (lo, hi, below, upto - below)
    return found


def smallest_keys(df: DataFrame, group: str, key: Column, tie: str, wanted: dict[int, int]) -> dict[int, tuple[str, object]]:
    """(key, tie) of the n-th smallest row (1-based) of each group, ordered by key and then tie.

    ``key`` is text of lower-case hexadecimal digits of one length, such as a hash.
    """
    rows = df.select(F.col(group).cast("int").alias("g"), key.alias("k"), F.col(tie).alias("t"))
    found: dict[int, tuple[str, object]] = {}
    prefix = {g: "" for g, n in wanted.items() if n > 0}
    rank = dict(wanted)
    width = DIGITS
    while prefix:
        here = None
        for g, p in prefix.items():
            c = (F.col("g") == g) & F.col("k").startswith(p)
            here = c if here is None else here | c
        inside = rows.where(here)
        # one histogram of the next digits, its running counts within a group of at most 16 ** DIGITS rows
        counts = inside.groupBy("g", F.substring("k", 1, width).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        held = {g: [] for g in prefix}
        for r in counts.orderBy("g", "p").collect():
            held[r["g"]].append((r["p"], r["n"]))
        few: dict[int, str] = {}
        longer: dict[int, str] = {}
        for g, bins in held.items():
            at = 0
            for p, n in bins:
                if at + n >= rank[g]:
                    rank[g] -= at
                    (few if n <= FEW_ROWS or width >= 32 else longer)[g] = p
                    break
                at += n
        if few:
            here = None
            for g, p in few.items():
                c = (F.col("g") == g) & F.col("k").startswith(p)
                here = c if here is None else here | c
            # equal rows (an id that repeats) are one row with a count
            last = rows.where(here).groupBy("g", "k", "t").agg(F.count(F.lit(1)).alias("n")).orderBy("g", "k", "t").collect()
            for r in last:
                if r["g"] not in found:
                    rank[r["g"]] -= r["n"]
                    if rank[r["g"]] <= 0:
                        found[r["g"]] = (r["k"], r["t"])
        prefix = longer
        width += DIGITS
    return found
