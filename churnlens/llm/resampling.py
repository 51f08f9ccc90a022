"""Importance resampling towards a target distribution, over hashed word n-grams.

A batch's texts are joined by a separator byte that no UTF-8 text holds, one regex pass finds the
words of all of them, and ``searchsorted`` over the documents' offsets masks the n-grams that would
cross two documents before ``bincount`` adds up the buckets.  Two such passes read the texts:

1. each task counts its features in one array of ``buckets`` numbers; the sums over the documents
   and over the target give every bucket a gain, the log ratio of the smoothed shares in 1/1000;
2. each document's weight is the floored mean gain of its features.

Gumbel noise from a hash of the id turns the weights into scores, whose highest ones are the drawn
documents (sampling without replacement, proportional to exp(weight / 1000)).  The draw's lowest
score comes from a histogram of scores, and only rows from there on are put in order, by ranges.
The histogram is bounded: gains are logarithms of 64-bit counts, so scores lie between -100,000 and
130,000 whatever the input, and it has at most one row for each of them.

Defined results: null and empty texts have no words, weight 0, and are never drawn while
``min_words`` is above 0; a null id is hashed as empty text and loses ties; repeated rows count and
compete as often as they occur, and rows equal in id and score share out consecutive ranks among
them; contents of very long texts are read in slices of ``SLICE_BYTES``, cut between words; an empty
document table gives no rows; an empty target gives every bucket the gain of a count of zero; columns
other than those named are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import byte_view, materialised, units

#: Bytes of text joined for one regex pass, and the longest slice of one text.
SLICE_BYTES = 2 << 20
#: Words whose buckets a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Rows of the draw in one range.
RANGE_ROWS = 250_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SEPARATOR = b"\xff"
_WORD = re.compile(rb"[0-9a-z\x80-\xfe]+|\xff")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class _Buckets(dict):
    """Word -> bucket; the separator's is -1."""

    def __init__(self, buckets: int):
        super().__init__({_SEPARATOR: -1})
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self[_SEPARATOR] = -1
        found = self[word] = zlib.crc32(word) % self.buckets
        return found


def _slices(raw: np.ndarray, grams: int) -> Iterator[tuple[bytes, int]]:
    """A text in slices cut between words, each after the last ``grams - 1`` words before it; their number comes second."""
    at, begin, before = 0, 0, 0
    while len(raw) - at > SLICE_BYTES:
        gaps = np.flatnonzero(~_IN_WORD[raw[at + 1 : at + SLICE_BYTES]])
        if len(gaps):
            stop = at + 1 + int(gaps[-1])
        else:  # one word longer than a slice: it stays whole
            rest = np.flatnonzero(~_IN_WORD[raw[at + SLICE_BYTES :]])
            stop = at + SLICE_BYTES + int(rest[0]) if len(rest) else len(raw)
        yield raw[begin:stop].tobytes().translate(_LOWER), before
        inside = _IN_WORD[raw[begin:stop]]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) + begin
        before = min(grams - 1, len(starts))
        begin = int(starts[-before]) if before else stop
        at = stop
    yield raw[begin:].tobytes().translate(_LOWER), before


def features(texts: pa.Array, known: _Buckets, grams: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, words, bucket) arrays of blocks of the texts: one entry a feature, ``words`` its length."""
    data, offs = byte_view(texts)
    parts: list[bytes] = []
    owner: list[int] = []
    skipped: list[int] = []
    size = 0
    for i in range(len(offs) - 1):
        for part, before in _slices(data[offs[i] : offs[i + 1]], grams):
            parts.append(part), owner.append(i), skipped.append(before)
            size += len(part)
            if size >= SLICE_BYTES:
                yield _features(parts, np.array(owner), np.array(skipped), known, grams)
                parts, owner, skipped, size = [], [], [], 0
    if parts:
        yield _features(parts, np.array(owner), np.array(skipped), known, grams)


def _features(parts: list[bytes], owner: np.ndarray, skipped: np.ndarray, known: _Buckets, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = _WORD.findall(_SEPARATOR.join(parts))
    codes = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    offsets = np.concatenate([[0], np.flatnonzero(codes < 0) + 1])  # where each part's words begin
    at = np.flatnonzero(codes >= 0)
    part = np.searchsorted(offsets, at, side="right") - 1
    found = []
    for n in range(1, grams + 1):
        last = at + n - 1
        inside = last < len(codes)
        inside[inside] = (codes[last[inside]] >= 0) & (np.searchsorted(offsets, last[inside], side="right") - 1 == part[inside])
        # features that lie wholly in the words repeated from the slice before were counted there
        inside &= last - offsets[part] >= skipped[part]
        begin = at[inside]
        bucket = codes[begin] if n == 1 else np.fromiter((zlib.crc32(b" ".join(words[i : i + n])) % known.buckets for i in begin.tolist()), np.int32, len(begin))
        found.append((owner[part[inside]], np.full(len(begin), n, np.int32), bucket))
    return tuple(np.concatenate(x) for x in zip(*found))


def bucket_counts(texts: DataFrame, text: str = "text", grams: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how often features of all texts fall in each bucket; at most ``buckets`` rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), _Buckets(buckets)
        for unit in units(batches, "text"):
            for _, _, bucket in features(unit.column("text"), known, grams):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(F.col(text).alias("text")).mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", grams: int = 1, buckets: int = 10_000) -> list[int]:
    """Gain of every bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    seen = bucket_counts(docs, text, grams, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    wanted = bucket_counts(target, target_text, grams, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = materialised(seen.unionByName(wanted).unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    sums = counts.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    ratio = f"(t + 1D) * ({sums['S']} + {buckets}D) / ((s + 1D) * ({sums['T']} + {buckets}D))"
    rows = counts.select("bucket", F.expr(f"floor(1000D * ln({ratio}))").alias("gain")).collect()  # ``buckets`` rows
    gains = [0] * buckets
    for r in rows:
        gains[r["bucket"]] = r["gain"]
    return gains


def weighted(docs: DataFrame, gains: list[int], text: str = "text", grams: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, n_words, n_features and weight of each row."""
    sc, buckets = docs.sparkSession.sparkContext, len(gains)
    table = sc.broadcast(np.array(gains, np.int64))  # 8 bytes a bucket
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).alias("text"))
    out = f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_features long, weight long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = _Buckets(buckets), table.value
        for unit in units(batches, "text"):
            words, count, total = (np.zeros(unit.num_rows, np.int64) for _ in range(3))
            for doc, length, bucket in features(unit.column("text"), known, grams):
                words += np.bincount(doc[length == 1], minlength=unit.num_rows)
                count += np.bincount(doc, minlength=unit.num_rows)
                total += np.bincount(doc, gain[bucket], unit.num_rows).astype(np.int64)
            weight = total // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([unit.column("row"), pa.array(words), pa.array(count), pa.array(weight)], names=["row", "n_words", "n_features", "weight"])

    return rows.mapInArrow(task, out).select("row.*", "n_words", "n_features", "weight")


def gumbel(doc_id: str = "doc_id", seed: int = 2024) -> Column:
    """Standard Gumbel noise of an id in whole 1/1000, from the first 32 bits of a hash."""
    h = f"cast(conv(substr(sha2(concat('{seed}:', coalesce(cast(`{doc_id}` AS string), '')), 256), 1, 8), 16, 10) AS double)"
    return F.expr(f"floor(-1000D * ln(-ln(({h} + 0.5D) / 4294967296D)))")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", grams: int = 1,
             buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; rows that are not drawn have no rank."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gains = bucket_gains(rows, target, "text", target_text, grams, buckets)
    scored = weighted(rows, gains, "text", grams).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    return ranked(materialised(scored, "scores"), percent, min_words)


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``rank`` 1, 2, 3 ... of the highest scores among rows of enough words; the rest has null.

    ``scored`` is a written table, so that its row numbers are the same in each use.
    """
    able = F.col("n_words") >= min_words
    histogram = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    # at most one row for each whole score between its fixed bounds
    above = histogram.withColumns({"above": F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n"), "total": F.sum("n").over(Window.partitionBy())})
    cut = above.withColumn("drawn", F.expr(f"total * {percent} div 100")).where("above < drawn").agg(F.min("score").alias("score"), F.max("drawn").alias("drawn"), F.max(F.col("above") + F.col("n")).alias("rows")).first()
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    null = F.lit(None).cast("long").alias("rank")
    if cut["score"] is None:
        return scored.select(*columns, null)
    high = able & (F.col("score") >= cut["score"])
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_at")]
    ranges = max(1, -(-cut["rows"] // RANGE_ROWS))
    top = scored.where(high).withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(ranges, *order)
    top = materialised(top.withColumn("_part", F.spark_partition_id()), "drawn")
    before = top.groupBy("_part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("_part")) - F.col("n")).drop("n")
    place = F.col("before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    top = top.join(before, "_part").withColumn("place", place)
    return scored.where(~high).select(*columns, null).unionByName(top.select(*columns, F.when(F.col("place") <= cut["drawn"], F.col("place")).cast("long").alias("rank")))


def oracle(percent: int = 10, min_words: int = 20, buckets: int = 10_000, seed: int = 2024) -> str:
    """The same rows in DuckDB's SQL, for features of one word."""
    return rf"""WITH steps AS (SELECT i, [i] AS c FROM range(256) r(i)),
crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM steps),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT rid, unnest(w) AS w FROM d),
bw AS (SELECT unnest(w) AS w FROM b),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
coded AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
  lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM vocabulary, crc_table),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN coded USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN coded USING (w) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS big_s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS big_t),
gains AS (SELECT r.bucket, floor(1000::DOUBLE * ln((coalesce(t.n, 0) + 1)::DOUBLE * (big_s + {buckets}) / ((coalesce(s.n, 0) + 1)::DOUBLE * (big_t + {buckets}))))::BIGINT AS gain
  FROM range({buckets}) r(bucket) LEFT JOIN s ON s.bucket = r.bucket LEFT JOIN t ON t.bucket = r.bucket, totals),
sums AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS total FROM dw JOIN coded USING (w) JOIN gains USING (bucket) GROUP BY rid),
weights AS (SELECT d.rid, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
  list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', sha256('{seed}:' || coalesce(doc_id::VARCHAR, ''))[i]) - 1)::BIGINT)), lambda a, x: a * 16 + x) AS h
  FROM d LEFT JOIN sums ON sums.rid = d.rid),
scored AS (SELECT rid, doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + floor(-1000::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM weights),
able AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS total FROM scored WHERE n_features >= {min_words})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= total * {percent} // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN able ON able.rid = scored.rid"""
