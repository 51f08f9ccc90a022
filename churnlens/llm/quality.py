"""Quality rules whose thresholds adapt to each language and source.

Four integer features of each document are counted inside its own row (no shuffle of text):
mean word length, symbols per word, repeated lines and words in repeated 3-word windows.
Each (language, source) keeps a quantile sketch of each feature: a log-linear histogram,
whose bucket is the value cut to its ``SKETCH_BITS`` leading bits (relative error below
1 / 2**(SKETCH_BITS - 1)).  Sketches are rows of counts, so they merge by adding: tasks
pre-aggregate, sources merge into their language and languages into the corpus.  Fences lie
``FENCE`` interquartile ranges outside the quartiles, with a least spread per feature; a
group of fewer than ``GROUP_ROWS`` documents with words takes the fences of its language,
a small language those of the corpus.  The fences are joined back to the documents.

Defined results: null text has no words and fails the base rule; null language or source is
a group of its own; repeated rows count as often as they occur; an empty table gives no rows;
columns beyond the four named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import materialised

SPACE = r"[\x20\x09-\x0D]+"
SKETCH_BITS = 6
FENCE = 3
GROUP_ROWS = 200
MIN_WORDS = 50
#: feature -> (numerator, denominator, scale, least spread, has a lower fence)
FEATURES = {
    "word_length": ("word_chars", "n_words", 100, 50, True),
    "symbols": ("n_symbols", "n_words", 1000, 20, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 100, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 50, False),
}


def text_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, n_lines, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"),
                    F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    d = d.select("doc_id", "lang", "source", F.filter(F.split("t", SPACE), lambda w: w != "").alias("w"),
                 F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
                 F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
                 F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    d = d.select("doc_id", "lang", "source", "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"),
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.expr("if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> concat_ws(' ', w[i], w[i + 1], w[i + 2])))").alias("g"))
    keep = ["doc_id", "lang", "source", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    # windows are sorted only in a text that repeats one
    d = d.select(*keep, F.expr("if(size(array_distinct(g)) < size(g), sort_array(transform(g, (x, i) -> struct(x AS x, i AS i))), "
                               "cast(array() AS array<struct<x:string,i:int>>))").alias("s"))
    d = d.select(*keep, F.expr("if(size(s) = 0, cast(array() AS array<int>), sort_array(transform(filter(sequence(0, size(s) - 1), "
                               "j -> s[j].x = get(s, j - 1).x OR s[j].x = get(s, j + 1).x), j -> s[j].i)))").alias("p"))
    covered = "if(size(p) = 0, 0L, aggregate(sequence(0, size(p) - 1), 0L, (a, k) -> a + coalesce(least(3, get(p, k + 1) - p[k]), 3)))"
    return d.select(*keep, F.expr(covered).alias("n_repeat_words"))


def _value(name: str) -> str:
    top, below, scale, _, _ = FEATURES[name]
    return f"{top} * {scale}L div nullif({below}, 0)"


def sketches(features: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, n): a mergeable quantile sketch of each feature of each group."""
    rows = features.where("n_words > 0").select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.expr(_value(f)).alias("v")) for f in FEATURES])).alias("x"))
    shift = f"greatest(length(bin(x.v)) - {SKETCH_BITS}, 0)"
    rows = rows.select("lang", "source", F.col("x.feature").alias("feature"),
                       F.expr(f"shiftleft(shiftright(x.v, {shift}), {shift})").alias("bucket"))
    return rows.groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """Quartiles and row count of every group's merged sketch, one row for each group and feature."""
    merged = sketch.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "feature")
    merged = merged.withColumns({"below": F.sum("n").over(whole.orderBy("bucket")), "rows": F.sum("n").over(whole)})
    return merged.groupBy(*by, "feature").agg(
        F.max("rows").alias(f"{prefix}_n"), F.min(F.when(F.expr("below * 4 >= rows"), F.col("bucket"))).alias(f"{prefix}_lo"),
        F.min(F.when(F.expr("below * 4 >= rows * 3"), F.col("bucket"))).alias(f"{prefix}_hi"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with <feature>_min and <feature>_max."""
    own = quartiles(sketch, ["lang", "source"], "own")
    tongue = quartiles(sketch, ["lang"], "tongue").withColumnRenamed("lang", "l").withColumnRenamed("feature", "f")
    every = quartiles(sketch, [], "every").withColumnRenamed("feature", "e")
    all_ = own.join(tongue, F.expr("lang <=> l AND feature = f")).join(every, F.expr("feature = e"))
    pick = {q: F.expr(f"CASE WHEN own_n >= {GROUP_ROWS} THEN own_{q} WHEN tongue_n >= {GROUP_ROWS} THEN tongue_{q} ELSE every_{q} END") for q in ("lo", "hi")}
    all_ = all_.select("lang", "source", "feature", pick["lo"].alias("lo"), pick["hi"].alias("hi"))
    aggs = []
    for f, (_, _, _, spread, lower) in FEATURES.items():
        reach = f"{FENCE} * greatest(hi - lo, {spread})"
        aggs.append(F.max(F.when(F.col("feature") == f, F.expr(f"hi + {reach}"))).alias(f"{f}_max"))
        if lower:
            aggs.append(F.max(F.when(F.col("feature") == f, F.expr(f"lo - {reach}"))).alias(f"{f}_min"))
    return all_.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(*aggs)


def quality_rules(docs: DataFrame, **columns: str) -> DataFrame:
    """The features of each document, base_failed and kept."""
    features = materialised(text_features(docs, **columns), "quality")
    limits = materialised(fences(sketches(features)), "fences")
    judged = features.join(limits, F.expr("lang <=> f_lang AND source <=> f_source"), "left")
    inside = [f"{_value(f)} <= {f}_max" for f in FEATURES] + [f"{_value(f)} >= {f}_min" for f, x in FEATURES.items() if x[4]]
    base = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words")
    kept = F.expr(f"n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= 50 * n_words AND coalesce(" + " AND ".join(inside) + ", true)")
    return judged.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"))


def oracle() -> str:
    """The same rules in DuckDB's SQL."""
    value = {f: f"{a} * {s} // {b}" for f, (a, b, s, _, _) in FEATURES.items()}
    long = " UNION ALL ".join(f"SELECT lang, source, '{f}' AS feature, {value[f]} AS v FROM feat WHERE n_words > 0" for f in FEATURES)
    shift = f"greatest(length(bin(v)) - {SKETCH_BITS}, 0)"

    def quart(name: str, by: str) -> str:
        keys = by + ", " if by else ""
        return f"""{name}_m AS (SELECT {keys}feature, bucket, sum(n) AS n FROM sk GROUP BY {keys}feature, bucket),
{name}_w AS (SELECT *, sum(n) OVER (PARTITION BY {keys}feature ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {keys}feature) AS total FROM {name}_m),
{name} AS (SELECT {keys}feature, max(total) AS n, min(bucket) FILTER (below * 4 >= total) AS lo, min(bucket) FILTER (below * 4 >= total * 3) AS hi FROM {name}_w GROUP BY {keys}feature)"""

    pick = {q: f"CASE WHEN own.n >= {GROUP_ROWS} THEN own.{q} WHEN tongue.n >= {GROUP_ROWS} THEN tongue.{q} ELSE every.{q} END AS {q}" for q in ("lo", "hi")}
    ends = ", ".join(f"max(hi + {FENCE} * greatest(hi - lo, {x[3]})) FILTER (feature = '{f}') AS {f}_max, max(lo - {FENCE} * greatest(hi - lo, {x[3]})) FILTER (feature = '{f}') AS {f}_min" for f, x in FEATURES.items())
    inside = " AND ".join([f"{value[f]} <= {f}_max" for f in FEATURES] + [f"{value[f]} >= {f}_min" for f, x in FEATURES.items() if x[4]])
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
feat AS (SELECT w.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, len(lines) AS n_lines,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON rep.rid = w.rid),
x AS ({long}),
sk AS (SELECT lang, source, feature, (v >> {shift}) << {shift} AS bucket, count(*) AS n FROM x GROUP BY ALL),
{quart("own", "lang, source")},
{quart("tongue", "lang")},
{quart("every", "")},
picked AS (SELECT own.lang, own.source, own.feature, {pick["lo"]}, {pick["hi"]} FROM own JOIN tongue ON own.lang IS NOT DISTINCT FROM tongue.lang AND own.feature = tongue.feature JOIN every ON own.feature = every.feature),
fence AS (SELECT lang AS fl, source AS fs, {ends} FROM picked GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= 50 * n_words AND coalesce({inside}, true) AS kept
FROM feat LEFT JOIN fence ON lang IS NOT DISTINCT FROM fl AND source IS NOT DISTINCT FROM fs"""
