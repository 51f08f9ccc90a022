"""How far each source's wording departs from its language's other sources.

Texts become arrays of terms, each written behind its language, so that one fitted vocabulary keeps
every language's own terms apart.  MLlib's CountVectorizer, with a least document frequency and no
limit on its size, learns the vocabulary and gives exact sparse count vectors.  It holds its
vocabulary on the driver, so past ``SHARD_TERMS`` distinct terms these are dealt by hash to shards of
about that many, and each shard is fitted and summed on its own; a document's terms of one shard are
one row there, so its document frequencies, and all results, are the same.

Sums over the vectors of each (language, source) are rows of integers, pre-aggregated by task, and
meet as one row for each term with a cell for each group that has it.
A source's share of a term is p = 1 + floor(SCALE (count + 1) / (N + V)); two shares differ by
floor((p - q)^2 / q).  Sums of that over a whole vocabulary come from sparse parts alone: terms that
neither source has (all alike), terms that one has (by its counts' histogram) and terms that both
have (pairs of a term's cells).  Terms of unusual weight are ranked against the whole language.

Defined results: null text, language and source are read as empty; a group without terms is kept;
a language of one source has no pairs, one without kept terms has the value 0; repeated rows count as
often as they occur; ties rank by the item's UTF-8 bytes; a text's terms are one array, so the longest
text's terms must fit in a task several times; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import byte_view, expand, materialised, scratch, units
from churnlens.llm.repeats import mixed

SCALE = 1_000_000_000
#: Distinct terms, kept or not, that one fitted vocabulary is dealt (by an estimate); the driver needs some 200 bytes for each kept one.
SHARD_TERMS = 4_000_000
#: Bytes of text whose terms are found together.
UNIT_BYTES = 4 << 20
#: Registers of the sketch that estimates distinct terms (a power of two; error about 1.6 %).
REGISTERS = 4096
#: Vector places that a task holds before it merges them, and pairs of a term's groups evaluated at a time.
CELLS = 4_000_000
PAIRS = 1 << 19
#: Between a language and its term; no term holds it.
MARK = "\0"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def texts_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, terms) of each row; every term stands behind its language."""
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, "text", UNIT_BYTES):
            langs = unit.column("lang").dictionary_encode()
            for k, name in enumerate(langs.dictionary.to_pylist()):
                own = unit.filter(pc.equal(langs.indices, k))
                words, offsets = _words(own.column("text"))
                coded = words.dictionary_encode()
                marked = pc.binary_join_element_wise(pa.scalar((name + MARK).encode(), pa.binary()), coded.dictionary, b"")
                terms = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), marked.take(coded.indices).cast(pa.string()))
                registers = pa.array([_registers(marked), *[None] * (own.num_rows - 1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([own.column("lang"), own.column("source"), terms, registers], names=["lang", "source", "terms", "registers"])

    return rows.mapInArrow(task, "lang string, source string, terms array<string>, registers array<int>")


def _registers(terms: pa.Array) -> list[int]:
    """Of a HyperLogLog sketch: the longest run of leading zeros, plus one, of the hashes that fall to each register.

    A term's hash is the sum of its bytes times fixed odd numbers, one for each place, scrambled.
    """
    data, offs = byte_view(terms)
    place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    factors = mixed(np.arange(1, 1 + (int(place.max()) + 1 if len(place) else 0), dtype=np.uint64)) | np.uint64(1)
    found = np.zeros(REGISTERS, np.int32)
    if len(data):
        hashes = mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * factors[place], offs[:-1]))
        rest = (hashes // np.uint64(REGISTERS)).astype(np.float64)
        zeros = 64 - int(math.log2(REGISTERS)) - np.frexp(rest)[1]
        np.maximum.at(found, (hashes % np.uint64(REGISTERS)).astype(np.int64), zeros + 1)
    return found.tolist()


def _distinct(rows: DataFrame) -> float:
    """About the number of distinct terms: the registers' largest values meet in one row for each register."""
    best = rows.where(F.col("registers").isNotNull()).select(F.posexplode("registers").alias("k", "r")).groupBy("k").agg(F.max("r").alias("r"))
    got = best.agg(F.sum(F.expr("pow(2D, -r)")).alias("s"), F.sum(F.when(F.col("r") == 0, 1).otherwise(0)).alias("empty")).first()
    if got["s"] is None:
        return 0.0
    raw = 0.7213 / (1 + 1.079 / REGISTERS) * REGISTERS**2 / got["s"]
    return REGISTERS * math.log(REGISTERS / got["empty"]) if got["empty"] and raw < 2.5 * REGISTERS else raw


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms of all texts, number of the first one of each text and the end)."""
    data, offs = byte_view(texts)
    low = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    inside = _IN_TERM[low]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offs[:-1][np.diff(offs) > 0]  # texts touch, their terms don't
    begins[edge] = inside[edge]
    ends[edge[1:] - 1] = inside[edge[1:] - 1]
    at = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - at
    places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(low[inside].tobytes())])
    return words, np.searchsorted(at, offs)


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, lang, source, terms): each row's terms in one row for each shard that has some."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            coded = lists.flatten().dictionary_encode()
            of_term = np.fromiter((zlib.crc32(w.encode()) % shards for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            codes = coded.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            key = row * shards + of_term[codes]
            order = np.argsort(key, kind="stable")
            found, first = np.unique(key[order], return_index=True)
            terms = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), coded.dictionary.take(pa.array(codes[order])))
            of = pa.array(found // shards)
            yield pa.RecordBatch.from_arrays([pa.array(found % shards, pa.int32()), batch.column("lang").take(of), batch.column("source").take(of), terms], names=["shard", "lang", "source", "terms"])

    return rows.mapInArrow(task, "shard int, lang string, source string, terms array<string>")


def term_table(docs: DataFrame, min_df: int = 3, text: str = "text", lang: str = "lang", source: str = "source", shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, DataFrame]:
    """((g, lang, source) of every group, (lang, term, cells) of every kept term); both written.

    ``cells`` is an array of (g, n): the groups that have the term and how often, at most one for each source.
    """
    spark = docs.sparkSession
    path = scratch(spark, "terms")
    written = {"parquet.enable.dictionary": "false", "compression": "snappy"}  # nearly all terms of a file differ
    texts_terms(docs, text, lang, source).write.options(**written).parquet(path)
    rows = spark.read.parquet(path)
    groups = rows.groupBy("lang", "source").agg(F.lit(True).alias("present")).select("lang", "source", F.monotonically_increasing_id().alias("g"))
    groups = materialised(groups, "groups")
    shards = max(1, math.ceil(_distinct(rows) / shard_terms))
    if shards > 1:
        path = scratch(spark, "shards")
        _dealt(rows, shards).write.options(**written).partitionBy("shard").parquet(path)
        rows = spark.read.schema("lang string, source string, terms array<string>, shard int").parquet(path)
    parts = []
    for k in range(shards):
        own = (rows.where(F.col("shard") == k) if shards > 1 else rows).select("lang", "source", "terms")
        vectors, vocabulary = document_vectors(own, min_df)
        sums = _vector_sums(vectors.join(groups, ["lang", "source"]).select("g", F.unwrap_udt("vector").alias("v")))
        cells = sums.repartition("i").groupBy("i", "g").agg(F.sum("n").alias("n")).groupBy("i").agg(F.collect_list(F.struct("g", "n")).alias("cells"))
        mark = F.length("w") - F.length(F.substring_index("w", MARK, -1))
        named = vocabulary.select("i", F.substring("w", F.lit(1), mark - 1).alias("lang"), F.substring_index("w", MARK, -1).alias("term"))
        parts.append(materialised(cells.join(named, "i").select("lang", "term", "cells"), f"cells-{k}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return groups, out


def _vector_sums(vectors: DataFrame) -> DataFrame:
    """(g, i, n): each task's sums of the vectors of a group, place by place."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            g, i, n = (np.concatenate(x) for x in zip(*parts))
            names, code = np.unique(g, return_inverse=True)
            key = code.astype(np.int64) << 32 | i
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            return names[key[first] >> 32], (key[first] & 0xFFFFFFFF).astype(np.int32), np.add.reduceat(n[order], first) if len(key) else n

        def rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            g, i, n = merged(parts)
            for at in range(0, len(g), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(g[s]), pa.array(i[s]), pa.array(n[s])], names=["g", "i", "n"])

        for batch in batches:
            v = batch.column("v")
            places, values = v.field("indices"), v.field("values")
            g = np.repeat(batch.column("g").to_numpy(), pc.list_value_length(places).to_numpy(zero_copy_only=False))
            held.append((g, places.flatten().to_numpy(), values.flatten().to_numpy().astype(np.int64)))
            size += len(g)
            if size > CELLS:
                held = [merged(held)]
                size = len(held[0][0])
                if size > CELLS // 2:  # too many to keep: the rest is merged after the shuffle
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    return vectors.mapInArrow(task, "g long, i int, n long")


def document_vectors(rows: DataFrame, min_df: int) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with the exact counts of the kept terms as a sparse vector, (i, w) of the vector's places)."""
    spark = rows.sparkSession
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=(1 << 31) - 1).fit(rows)
    path = scratch(spark, "vocabulary")
    model.save(path)
    words = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("i", "w"))
    return model.transform(rows).drop("terms"), words


def _share(count: str, total: str, size: str) -> str:
    """p of a count: whole-number arithmetic of 38 digits."""
    return f"(1L + cast((cast({SCALE} AS decimal(10, 0)) * cast({count} + 1 AS decimal(19, 0))) div (cast({total} + {size} AS decimal(19, 0))) AS long))"


def _apart(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def audit(docs: DataFrame, min_df: int = 3, top: int = 200, **options) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (every other source) and ``term`` (the ``top`` unusual ones)."""
    groups, table = term_table(docs, min_df, **options)
    cells = table.select("lang", F.explode("cells").alias("c")).select("lang", "c.g", "c.n")
    counted = materialised(cells.groupBy("lang", "g", "n").agg(F.count("*").alias("times")), "counts")
    totals = counted.groupBy("g").agg(F.sum(F.col("n") * F.col("times")).alias("total"))
    sizes = table.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = groups.join(totals, "g", "left").join(sizes, "lang", "left").na.fill(0, ["total", "kept"])
    groups = materialised(groups.withColumn("p0", F.expr(f"if(kept = 0, 0L, {_share('0', 'total', 'kept')})")), "group-sizes")
    met = materialised(_evaluated(table, groups), "evaluated")
    best = Window.partitionBy("g")
    terms = met.where("h IS NULL").withColumn("rank", F.row_number().over(best.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top).select("g", "item", "value", "rank")
    pairs = _pairs(groups, counted, met.where("h IS NOT NULL"))
    pairs = pairs.join(groups.select(F.col("g").alias("h"), F.col("source").alias("item")), "h")
    pairs = pairs.withColumn("rank", F.row_number().over(best.orderBy(F.desc("value"), "item"))).select("g", "item", "value", "rank")
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.join(groups.select("g", "lang", "source"), "g").select("lang", "source", "part", "item", "value", "rank")


def _evaluated(table: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, h, item, value): with h, the part of a pair's sum that shared terms add; without, the value of a term of a group.

    Every worker reads the groups' sizes: four numbers for each group, where the result has a row for each two.
    """
    sc = table.sparkSession.sparkContext
    sized = groups.select("g", "lang", "total", "kept", "p0").collect()
    whole: dict[str, int] = {}
    for r in sized:
        whole[r["lang"]] = whole.get(r["lang"], 0) + r["total"]
    sized.sort(key=lambda r: r["g"])
    stats = sc.broadcast((np.array([r["g"] for r in sized], np.int64), np.array([r["total"] + r["kept"] for r in sized], np.int64), np.array([r["p0"] for r in sized], np.int64),
                          np.array([whole[r["lang"]] + r["kept"] for r in sized], np.int64)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, size, zero, lang_size = stats.value
        empty = pa.nulls(0, pa.string())
        for batch in batches:
            cells = batch.column("cells")
            lengths = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = cells.flatten()
            g = np.searchsorted(names, flat.field("g").to_numpy())
            n = flat.field("n").to_numpy()
            first = np.cumsum(lengths) - lengths
            p = _shares(n, size[g])
            q = _shares(np.repeat(np.add.reduceat(n, first), lengths) if len(n) else n, lang_size[g])
            over = np.flatnonzero(p > q)
            of_term = np.repeat(np.arange(len(lengths)), lengths)
            value = (p[over] - q[over]) ** 2 // q[over]
            yield pa.RecordBatch.from_arrays([pa.array(names[g[over]]), pa.nulls(len(over), pa.int64()), batch.column("term").take(pa.array(of_term[over])), pa.array(value)], names=["g", "h", "item", "value"])
            at = 0
            pairs_upto = np.cumsum(lengths * lengths)
            while at < len(lengths):
                to = max(at + 1, int(np.searchsorted(pairs_upto, (pairs_upto[at - 1] if at else 0) + PAIRS, side="right")))
                z = lengths[at:to]
                a = np.repeat(np.arange(first[at], first[at] + z.sum()), np.repeat(z, z))
                b = expand(np.repeat(first[at:to], z), np.repeat(z, z))
                apart = g[a] != g[b]
                a, b = a[apart], b[apart]
                at = to
                if not len(a):
                    continue
                used, local = np.unique(g[first[to - len(z)] : first[to - 1] + z[-1]], return_inverse=True)
                local = np.concatenate([np.zeros(first[to - len(z)], np.int64), local])
                code = local[a] * len(used) + local[b]
                if len(used) ** 2 > 4 * PAIRS:
                    codes, code = np.unique(code, return_inverse=True)
                else:
                    codes = np.arange(len(used) ** 2)
                pa_, pb, a0, b0 = p[a], p[b], zero[g[a]], zero[g[b]]
                add = (pa_ - pb) ** 2 // pb - (pa_ - b0) ** 2 // b0 - (a0 - pb) ** 2 // pb + (a0 - b0) ** 2 // b0
                total = np.zeros(len(codes), np.int64)
                np.add.at(total, code, add)
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(names[used[codes[some] // len(used)]]), pa.array(names[used[codes[some] % len(used)]]), pa.nulls(len(some), pa.string()), pa.array(total[some])],
                                                 names=["g", "h", "item", "value"])
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), empty, pa.array([], pa.int64())], names=["g", "h", "item", "value"])

    return table.select("term", "cells").mapInArrow(task, "g long, h long, item string, value long")


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """p of counts; counts whose product with SCALE leaves 64 bits are worked out one by one."""
    if len(count) and int(count.max()) >= (1 << 63) // SCALE - 1:
        return np.array([1 + SCALE * (c + 1) // t for c, t in zip(count.tolist(), total.tolist())], np.int64)
    return 1 + SCALE * (count + 1) // total


def _pairs(groups: DataFrame, counted: DataFrame, met: DataFrame) -> DataFrame:
    """(g, h, value) for every ordered pair of sources of a language, from sparse parts."""
    one = groups.select("lang", "g", F.col("p0").alias("a0"), "kept")
    other = groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("b0"))
    pairs = one.join(other, "lang").where("g <> h")
    neither = _apart("a0", "b0")
    shares = counted.join(groups.select("g", "total", "kept"), "g").select("g", F.expr(_share("n", "total", "kept")).alias("p"), F.col("times").alias("n"))
    whole = "cast({} AS decimal(20, 0)) AS value"
    parts = [
        met.selectExpr("g", "h", whole.format("value")),
        pairs.selectExpr("g", "h", whole.format(f"if(kept = 0, 0L, kept * {_apart('a0', 'greatest(b0, 1L)')})")),
        pairs.join(shares, "g").selectExpr("g", "h", whole.format(f"n * ({_apart('p', 'b0')} - {neither})")),
        pairs.join(shares.withColumnRenamed("g", "h"), "h").selectExpr("g", "h", whole.format(f"n * ({_apart('a0', 'p')} - {neither})")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("g", "h").agg(F.sum("value").cast("long").alias("value"))


def oracle(min_df: int = 3, top: int = 200) -> str:
    """The same rows in DuckDB's SQL, over dense vocabularies."""
    share = f"1 + {SCALE}::HUGEINT * ({{}} + 1) // ({{}} + V)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {min_df}),
v AS (SELECT lang, count(*) AS V FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
has AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
cells AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN has h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
sized AS (SELECT c.*, V, sum(n) OVER (PARTITION BY c.lang, source) AS big_n, sum(n) OVER (PARTITION BY c.lang, term) AS in_lang, sum(n) OVER (PARTITION BY c.lang) AS big_l FROM cells c JOIN v ON v.lang = c.lang),
p AS (SELECT lang, source, term, n, {share.format('n', 'big_n')} AS p, {share.format('in_lang', 'big_l')} AS q FROM sized),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN summed USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
