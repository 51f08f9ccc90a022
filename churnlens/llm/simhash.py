"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints: 64 bits, a bit is 1 if it is set in over half of the XXH64 values of a
text's word shingles.  Two fingerprints link if they differ in at most ``threshold`` bits.

Search: the 64 bits are split into three blocks of 21, 21 and 22 bits.  Of two linked
fingerprints some block differs in at most ``threshold // 3`` bits.  The anchors of a
block are the words of a covering code: a perfect [15, 11] Hamming code on its first 15
bits, all values of the remaining bits.  Every block value lies within the code's covering
radius (1) of an anchor, its home; a value that differs in at most t bits lies within
radius + t of that anchor.  So each fingerprint goes once to its home and is replicated to
all anchors within radius + t, and an anchor compares its homes with its visitors.  Only
distinct fingerprints are compared (copies of a text share one), links of an anchor
are reduced to a spanning forest before they leave it, and the components are found by
star contraction on the cluster.

Defined results: null or blank text has fingerprint zero and links like any other; rows
that repeat share a fingerprint; a null id never names a component unless it holds null
ids alone; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import materialised, row_key, units, words_of
from churnlens.llm.components import connected_components

SHINGLE_WORDS = 4
THRESHOLD = 4
SEED = 42
#: (first bit, number of bits) of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Length of the Hamming code, and the number of free bits that never make the covering radius larger.
CODE_BITS = 15

def text_fingerprints(texts: pa.Array, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprint of each text (unsigned 64-bit)."""
    import xxhash

    n = len(texts)
    text, starts, ends, first = words_of(texts, lower=True)
    words = np.diff(first)
    shingles = np.where(words > 0, np.maximum(words - shingle_words + 1, 1), 0)
    begin = np.repeat(first[:-1], shingles)
    lead = begin + np.arange(len(begin)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(lead + shingle_words, np.repeat(first[1:], shingles)) - 1
    digest = xxhash.xxh64_intdigest
    size = 1 << 18
    ones = np.zeros((n, 64), np.int64)
    doc = np.repeat(np.arange(n), shingles)
    for i in range(0, len(lead), size):
        a, b = starts[lead[i : i + size]].tolist(), ends[last[i : i + size]].tolist()
        h = np.fromiter((digest(text[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(a))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = doc[i : i + size]
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        for lo in range(0, len(cut), 4096):
            hi = cut[lo + 4096] if lo + 4096 < len(cut) else len(own)
            part = cut[lo : lo + 4096]
            ones[own[part]] += np.add.reduceat(bits[part[0] : hi], part - part[0], axis=0, dtype=np.int32)
    set_bits = 2 * ones > shingles[:, None]
    return np.packbits(set_bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, keyed: bool = False) -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs; ``keyed`` adds the text_key of ``row_key``."""
    names = ["doc_id", "text_key"] if keyed else ["doc_id"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, "text"):
            fp = text_fingerprints(unit.column("text"), shingle_words)
            yield pa.RecordBatch.from_arrays([*(unit.column(c) for c in names), pa.array(fp.view(np.int64))], names=[*names, "fp"])

    rows = docs.select(*row_key(doc_id, text)[: len(names)], F.col(text).alias("text"))
    return rows.mapInArrow(task, ", ".join(f"{c} long" for c in [*names, "fp"]))


def _syndromes() -> np.ndarray:
    """Syndrome of every 15-bit word under the Hamming code whose check of bit i is i + 1; 0 for code words."""
    s = np.zeros(1 << CODE_BITS, np.uint8)
    words = np.arange(1 << CODE_BITS)
    for i in range(CODE_BITS):
        s ^= np.where(words >> i & 1, np.uint8(i + 1), np.uint8(0))
    return s


def _flips(bits: int, most: int) -> list[np.ndarray]:
    """By weight: the masks of up to ``most`` flipped bits."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(bits), w)], dtype=np.int64) for w in range(most + 1)]


def anchors(values: np.ndarray, bits: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchor of each value, row numbers, anchors within ``reach`` of that row's value)."""
    syndrome = _syndromes()
    low, high = values & ((1 << CODE_BITS) - 1), values >> CODE_BITS
    s = syndrome[low]
    home = (low ^ np.where(s > 0, 1 << (s.astype(np.int64) - 1), 0)) | high << CODE_BITS
    rows, found = [], []
    number = np.arange(len(values))
    for w, masks in enumerate(_flips(CODE_BITS, reach)):
        near = low[:, None] ^ masks[None, :]
        r, c = np.nonzero(syndrome[near] == 0)
        for masks_high in _flips(bits - CODE_BITS, reach - w):
            word = near[r, c][:, None] | (high[r][:, None] ^ masks_high[None, :]) << CODE_BITS
            rows.append(np.repeat(number[r], len(masks_high)))
            found.append(word.reshape(-1))
    return home, np.concatenate(rows), np.concatenate(found)


def replicate(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(block, anchor, home, fp): each fingerprint once at home and at every anchor within radius + t."""
    reach = 1 + threshold // len(BLOCKS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(at, 4096).to_numpy(zero_copy_only=False)
                raw = fp.view(np.uint64)
                for b, (first, bits) in enumerate(BLOCKS):
                    value = (raw >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)
                    home, rows, found = anchors(value, bits, reach)
                    anchor = np.concatenate([home, found]) | b << 32
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.arange(len(anchor)) < len(home)), pa.array(np.concatenate([fp, fp[rows]]))], names=["anchor", "home", "fp"])

    return distinct.select("fp").mapInArrow(task, "anchor long, home boolean, fp long")


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the edges between these positions."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for x, y in zip(left.tolist(), right.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            a.append(x), b.append(y)
    return a, b


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v): links between distinct fingerprints, enough of them to connect what is connected."""
    spark = distinct.sparkSession
    placed = replicate(distinct, threshold)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = placed.repartition(n, "anchor").sortWithinPartitions("anchor", F.desc("home"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
            anchor, home, fp = (t.column(c).to_numpy() for c in ("anchor", "home", "fp"))
            raw = fp.view(np.uint64)
            cut = np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1))
            ends = np.append(cut[1:], len(anchor))
            homes = np.add.reduceat(home.astype(np.int64), cut)
            visitors = ends - cut - homes
            # every home of an anchor against every visitor, a bounded number of pairs at a time
            rows = expand_pairs(cut, homes, visitors)
            for h, v in rows:
                near = np.bitwise_count(raw[h] ^ raw[v]) <= threshold
                near &= fp[h] != fp[v]
                h, v = h[near], v[near]
                if len(h):
                    names, codes = np.unique(np.concatenate([fp[h], fp[v]]), return_inverse=True)
                    a, b = _forest(codes[: len(h)], codes[len(h) :])
                    yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 1 << 17:
                t = pa.Table.from_batches(held)
                last = t.column("anchor")[-1].as_py()
                cut = int(np.searchsorted(t.column("anchor").to_numpy(), last))
                if cut:
                    yield from compared(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
        if held:
            yield from compared(pa.Table.from_batches(held))

    return placed.mapInArrow(task, "u long, v long").distinct()


def expand_pairs(cut: np.ndarray, homes: np.ndarray, visitors: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (home, visitor) of all pairs of each anchor, at most about ``most`` at a time."""
    # one line for each home: its visitors are a range
    total = int(homes.sum())
    if not total:
        return
    group = np.repeat(np.arange(len(cut)), homes)
    h = cut[group] + np.arange(total) - np.repeat(np.cumsum(homes) - homes, homes)
    first, count = (cut + homes)[group], visitors[group]
    done = np.cumsum(count)
    at = 0
    while at < total:
        base = done[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(done, base + most, side="right")))
        n = count[at:to]
        left = np.repeat(h[at:to], n)
        right = np.repeat(first[at:to] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield left, right
        at = to


def _labelled(least: DataFrame, threshold: int) -> DataFrame:
    """The rows (fp, least) with the ``label`` of their component."""
    found = connected_components(links(least, threshold))
    return least.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle_words: int = SHINGLE_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links of fingerprints."""
    marked = materialised(fingerprints(docs, doc_id, text, shingle_words), "simhash")
    least = materialised(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labelled = _labelled(least, threshold)
    heads = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(heads, "label").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, threshold: int = THRESHOLD, shingle_words: int = SHINGLE_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key): one row identity for each component, of its smallest id, a null id only among null ids."""
    marked = fingerprints(docs, doc_id, text, shingle_words, keyed=True)
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    least = materialised(marked.groupBy("fp").agg(F.min(first).alias("least")), "simhash-distinct")
    heads = _labelled(least, threshold).groupBy("label").agg(F.min("least").alias("head"))
    return heads.select("head.doc_id", "head.text_key")
