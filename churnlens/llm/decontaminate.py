"""Benchmark decontamination over a positional inverted index.

The index stores a posting (document, position, term, hash of the next word) for every training
token that is a term of the test set; it is written as a table.  A test window is anchored at its
term with the fewest postings in the corpus; the anchor's postings, moved back by its offset and
checked against the stored next word, give candidate starts, and the postings of all its other
terms, moved back by theirs, are intersected with them: a bit is set for each offset that is met,
and a start with all bits is an exact phrase.  With ``slop`` > 0 a term may also lie up to that
many places away from its own, which gives proximity matches.

The dictionary of test terms and the anchors are written tables, so Spark broadcasts them only
where their known size allows and shuffles them otherwise.

Defined results: null text has no words; rows equal in id and text are one document with
one result each; null item ids read as empty strings; items without words match nothing; an
empty table on either side gives no hits; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import materialised, row_key

#: Characters that part words, after A-Z are folded.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Stands for a null id in join keys.
NO_ID = -(1 << 62)


def words_column(text: str) -> Column:
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, BREAK), lambda w: w != "")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("k1"),
                       row_key(doc_id, text)[1].alias("k2"), words_column(text).alias("w"))


def item_windows(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window_id, item_id, w): every window of every item; equal windows share an id."""
    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), words_column(text).alias("w"))
    cut = F.expr(f"CASE WHEN size(w) = 0 THEN array() WHEN size(w) <= {window} THEN array(w) "
                 f"ELSE transform(sequence(1, size(w) - {window} + 1), i -> slice(w, i, {window})) END")
    each = materialised(own.select("item_id", F.explode(cut).alias("w")).distinct(), "test-windows")
    ids = materialised(each.select("w").distinct().withColumn("window_id", F.monotonically_increasing_id()), "test-window-ids")
    return materialised(each.join(ids, "w").select("window_id", "item_id", "w"), "test-items")


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, pos, term_id, nxt): postings of the ``terms`` (term, term_id) in all documents."""
    tokens = _keyed(docs, doc_id, text).select("k1", "k2", F.explode(F.expr(
        "transform(w, (x, i) -> struct(x AS term, i AS pos, xxhash64(get(w, i + 1)) AS nxt))")).alias("t"))
    tokens = tokens.select("k1", "k2", F.col("t.pos").alias("pos"), F.col("t.term").alias("term"), F.col("t.nxt").alias("nxt"))
    return materialised(tokens.join(terms, "term").select("k1", "k2", "pos", "term_id", "nxt"), "postings")


def matches(index: DataFrame, windows: DataFrame, terms: DataFrame, slop: int = 0) -> DataFrame:
    """(k1, k2, window_id, start, len, exact): phrase matches and, with ``slop``, proximity matches."""
    distinct = windows.select("window_id", "w").dropDuplicates(["window_id"])
    placed = distinct.select("window_id", F.size("w").alias("len"), F.explode(F.expr(
        "transform(w, (x, i) -> struct(x AS term, i AS off, if(i + 1 < size(w), xxhash64(get(w, i + 1)), null) AS nxt))")).alias("t"))
    placed = placed.select("window_id", "len", "t.*").join(terms, "term")
    freq = index.groupBy("term_id").agg(F.count("*").alias("freq"))
    placed = placed.join(freq, "term_id", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    by = Window.partitionBy("window_id")
    # the last term has no next word to check, so it anchors one-word windows only
    rank = F.row_number().over(by.orderBy((F.expr("off = len - 1 AND len > 1")), "freq", "off"))
    placed = materialised(placed.withColumns({"rank": rank, "least": F.min("freq").over(by)}).where("least > 0"), "test-terms")
    anchors = materialised(placed.where("rank = 1").select("window_id", "len", "off", "term_id", F.col("nxt").alias("want")), "anchors")
    near = F.expr("want IS NULL OR want = nxt") if not slop else F.lit(True)
    starts = index.join(anchors, "term_id").where(near).select("k1", "k2", "window_id", "len", (F.col("pos") - F.col("off")).alias("start"))
    if not slop:
        starts = starts.where("start >= 0")
    probe = starts.distinct().join(placed.select("window_id", "off", "term_id"), "window_id")
    probe = probe.withColumn("shift", F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0))
    probe = probe.withColumn("pos", F.expr("start + off + shift"))
    met = probe.join(index.select("k1", "k2", "pos", "term_id"), ["k1", "k2", "pos", "term_id"])
    bit = F.expr("shiftleft(1L, off)")
    met = met.groupBy("k1", "k2", "window_id", "start", "len").agg(F.bit_or(F.when(F.col("shift") == 0, bit)).alias("own"), F.bit_or(bit).alias("any"))
    full = F.expr("shiftleft(1L, len) - 1")
    return met.where(F.col("any") == full).select("k1", "k2", "window_id", "start", "len", F.coalesce(F.col("own") == full, F.lit(False)).alias("exact"))


def vocabulary(windows: DataFrame) -> DataFrame:
    """(term, term_id) of the test set."""
    each = windows.select(F.explode("w").alias("term")).distinct()
    return materialised(each.withColumn("term_id", F.monotonically_increasing_id()), "test-vocabulary")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", keyed: bool = False) -> DataFrame:
    """One row per document: n_words, n_hit (words inside a test window), n_items, items_sha256, contaminated;
    ``keyed`` adds the text_key of ``row_key``, which with the id tells the row."""
    windows = item_windows(items, window)
    terms = vocabulary(windows)
    index = build_index(docs, terms, doc_id, text)
    found = materialised(matches(index, windows, terms).where("exact"), "matches")
    key = ["k1", "k2"]
    words = found.select(*key, F.explode(F.expr("sequence(start, start + len - 1)")).alias("pos")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    hit_items = found.select(*key, "window_id").distinct().join(windows.select("window_id", "item_id"), "window_id").groupBy(*key).agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    base = _keyed(docs, doc_id, text).select("doc_id", *key, F.size("w").cast("long").alias("n_words"))
    out = base.join(words.join(hit_items, key), key, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                      F.coalesce(F.array_size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
                      F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), *([F.col("k2").alias("text_key")] if keyed else []))


def oracle() -> str:
    """The same result in DuckDB's SQL, by comparing windows as strings."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, CAST(least(len(w), {WINDOW}) AS BIGINT) AS n, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns)),
m AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.rid = d.rid LEFT JOIN t ON t.rid = d.rid"""
