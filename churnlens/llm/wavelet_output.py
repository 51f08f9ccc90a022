"""Token ids written as one wavelet matrix per shard, and read back from those files.

A wavelet matrix keeps a sequence as bit planes, highest bit first: plane ``b`` holds bit
``b`` of every id in the order that a stable partition by the planes above has left.  With
counts of ones per block (the rank directory) a shard answers, without decoding the rest,
which id stands at a place (``access``), how often an id occurs before a place (``rank``)
and where its k-th occurrence is (``select``).

``write_tokens`` sorts documents by id over the cluster, encodes them and writes a Parquet
row per shard (at most ``SHARD_TOKENS`` tokens, or one document), compressed by Parquet.
Spark's committer makes the write safe against lost executors.  ``read_documents_back``
decodes the planes; positions over all shards come from the shard lengths alone.

Defined results: null text is empty (its end id alone is written); rows that repeat are
written as often as they occur; null ids come first; an empty table gives files without
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm.common import partitions_for, scratch, tokenizer_path, units
from churnlens.llm.tokens import encoder

SHARD_TOKENS = 1 << 20
RANK_BLOCK = 4096
#: Ids that a plane's partition takes at a time, so that the places of its bits stay in the processor's cache.
CHUNK = 1 << 15
SHARD = "part int, seq int, n_tokens long, doc_ids array<long>, doc_tokens array<int>, zeros array<long>, planes array<binary>, ranks array<binary>"
DECODED = "part int, seq int, doc_id long, local_start long, n_tokens long, ids binary"


def _places(bit: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(chunk, places of its zeros, places of its ones), chunk by chunk; places are faster than masks, whose bits no processor foresees."""
    for at in range(0, len(bit), CHUNK):
        own = bit[at : at + CHUNK]
        yield slice(at, at + CHUNK), np.flatnonzero(~own), np.flatnonzero(own)


def _parted(now: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, int]:
    """(ids whose bit is 0 and then the others, in their order; number of the first)."""
    zeros = len(bit) - int(np.count_nonzero(bit))
    out, low, high = np.empty_like(now), 0, zeros
    for chunk, off, on in _places(bit):
        own = now[chunk]
        out[low : low + len(off)] = own[off]
        out[high : high + len(on)] = own[on]
        low, high = low + len(off), high + len(on)
    return out, zeros


def _joined(now: np.ndarray, bit: np.ndarray, zeros: int, value: np.integer) -> np.ndarray:
    """The ids in their order before ``_parted``, ``value`` added where the bit is 1."""
    out, low, high = np.empty_like(now), 0, zeros
    for chunk, off, on in _places(bit):
        own = out[chunk]
        own[off] = now[low : low + len(off)]
        own[on] = now[high : high + len(on)] | value
        low, high = low + len(off), high + len(on)
    return out


class WaveletMatrix:
    """Bit planes of a sequence of ids, with rank and select."""

    def __init__(self, length: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.length, self.zeros, self.planes, self.ranks = length, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = 8 * ids.dtype.itemsize
        now, zeros, planes, ranks = ids, [], [], []
        for b in reversed(range(width)):
            bit = (now & ids.dtype.type(1 << b)) != 0
            plane = np.packbits(bit)
            planes.append(plane.tobytes())
            ones = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), RANK_BLOCK // 8), dtype=np.int64) if len(bit) else np.zeros(0, np.int64)
            ranks.append((np.cumsum(ones) - ones).astype("<u4").tobytes())
            now, low = _parted(now, bit)
            zeros.append(low)
        return cls(len(ids), zeros, planes, ranks)

    def _ones(self, plane: int, at: int) -> int:
        """Ones of a plane before a place."""
        block = min(at // RANK_BLOCK, max(0, (self.length - 1) // RANK_BLOCK))
        if not self.length:
            return 0
        base = int(np.frombuffer(self.ranks[plane], "<u4")[block])
        raw = np.frombuffer(self.planes[plane], np.uint8, offset=block * RANK_BLOCK // 8)[: (at - block * RANK_BLOCK + 7) // 8]
        return base + int(np.unpackbits(raw)[: at - block * RANK_BLOCK].sum())

    def access(self, at: int) -> int:
        value = 0
        for plane, zeros in enumerate(self.zeros):
            ones = self._ones(plane, at)
            bit = self._ones(plane, at + 1) - ones
            at = zeros + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, at: int) -> tuple[int, int]:
        lo, hi = 0, at
        for plane, zeros in enumerate(self.zeros):
            a, b = self._ones(plane, lo), self._ones(plane, hi)
            lo, hi = (zeros + a, zeros + b) if token >> (len(self.zeros) - 1 - plane) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, at: int) -> int:
        """Occurrences of ``token`` before place ``at``."""
        lo, hi = self._range(token, at)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, counted from 0; -1 if there are no more than k."""
        lo, hi = self._range(token, self.length)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for plane in reversed(range(len(self.zeros))):
            bit = token >> (len(self.zeros) - 1 - plane) & 1
            at = self._nth(plane, at - self.zeros[plane] if bit else at, bit)
        return at

    def _nth(self, plane: int, k: int, bit: int) -> int:
        """Place of the k-th bit of this value in a plane."""
        before = np.frombuffer(self.ranks[plane], "<u4").astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * RANK_BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        raw = np.unpackbits(np.frombuffer(self.planes[plane], np.uint8)[block * RANK_BLOCK // 8 : (block + 1) * RANK_BLOCK // 8])
        raw = raw[: self.length - block * RANK_BLOCK]
        return block * RANK_BLOCK + int(np.flatnonzero(raw == bit)[k - before[block]])

    def decode(self) -> np.ndarray:
        """The whole sequence."""
        dtype = np.uint16 if len(self.planes) == 16 else np.uint32
        now = np.zeros(self.length, dtype)
        for b, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.length).view(bool)
            now = _joined(now, bit, zeros, dtype(1 << b))
        return now


def write_tokens(docs: DataFrame, out: str, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` in ascending id order as wavelet-matrix shards under ``out``."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(partitions_for(rows), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for unit in units(batches, "text"):
            ids, offs = encoder(path).encode(unit.column("text"))
            at = 0
            while at < unit.num_rows:
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + SHARD_TOKENS, side="right")) - 1)
                own = ids[offs[at] : offs[to]]
                m = WaveletMatrix.build(own)
                row = [part, seq, len(own), unit.column("doc_id").slice(at, to - at).to_pylist(), np.diff(offs[at : to + 1]).astype(np.int32), m.zeros, m.planes, m.ranks]
                types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[f.split()[0] for f in SHARD.split(", ")])
                at, seq = to, seq + 1

    rows.mapInArrow(task, SHARD).write.option("parquet.block.size", 16 << 20).parquet(out)


def shards(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(out)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"])


def shard_starts(table: DataFrame) -> DataFrame:
    """(part, seq, shard_start): ids before each shard, summed per part first."""
    sizes = table.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return sizes.select("part", "seq", inside.alias("inside")).join(before, "part").select("part", "seq", (F.col("inside") + F.col("part_start")).alias("shard_start"))


def read_documents_back(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the files; ids are little-endian unsigned 32-bit."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = _matrix(row).decode().astype("<u4")
                n = np.array(row["doc_tokens"], dtype=np.int64)
                ends = np.cumsum(n)
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * np.append(0, ends)).astype(np.int32)), pa.py_buffer(ids)])
                columns = [np.full(len(n), row["part"], np.int32), np.full(len(n), row["seq"], np.int32), pa.array(row["doc_ids"], pa.int64()), ends - n, n, raw]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in DECODED.split(", ")])

    table = shards(spark, out)
    rows = table.mapInArrow(task, DECODED).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return rows.join(shard_starts(table), ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(spark: SparkSession, out: str, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each token over all shards, by rank alone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = _matrix(row)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([m.rank(t, m.length) for t in tokens], pa.int64())], names=["token", "n"])

    return shards(spark, out).mapInArrow(task, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, out: str, token: int) -> DataFrame:
    """(part, seq, place): every occurrence of a token, by select."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = _matrix(row)
                places = [m.select(token, k) for k in range(m.rank(token, m.length))]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(places), pa.int32()), pa.array([row["seq"]] * len(places), pa.int32()), pa.array(places, pa.int64())], names=["part", "seq", "place"])

    return shards(spark, out).mapInArrow(task, "part int, seq int, place long")


def write_and_read_back(docs: DataFrame, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    out = scratch(spark, "wavelet")
    write_tokens(docs, out, path)
    return read_documents_back(spark, out)
