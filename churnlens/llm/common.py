"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import shared_path

#: Bytes of text that one Python work unit holds at a time.
UNIT_BYTES = 8 << 20
#: Bytes of text per shuffle partition.
PARTITION_BYTES = 24 << 20

#: One of the six ASCII white-space bytes, as a lookup table over byte values.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return shared_path(spark, spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex[:12]}")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which also cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, text: str = "text", each: int = PARTITION_BYTES, factor: float = 1.0) -> int:
    """Number of partitions that hold ``each`` bytes of ``text``: a function of the data alone."""
    total = df.agg(F.sum(F.octet_length(text).cast("long") + 16).alias("b")).first()["b"] or 0
    return max(1, math.ceil(total * factor / each))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells one document row from another: its id and the hash of its text.

    Rows equal in both are one document and share one result.
    """
    return [F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(0)).alias("text_key")]


def byte_view(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        values = values.fill_null("") if values.null_count else values
        width = np.int64 if pa.types.is_large_string(values.type) else np.int32
    else:
        values = values.fill_null(b"") if values.null_count else values
        width = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    _, offs, data = values.buffers()
    if not len(values) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    o = np.frombuffer(offs, width)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


#: What workers keep between tasks, by operator.
WORKER_CACHES: list[dict] = []


def begin_task(*keep: dict) -> None:
    """Called as a task begins: other operators' caches in this worker, and memory that earlier tasks freed, are given back."""
    for cache in WORKER_CACHES:
        if not any(cache is k for k in keep):
            cache.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def units(batches: Iterator[pa.RecordBatch], column: str, limit: int = UNIT_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, gathered or cut into batches of about ``limit`` bytes of ``column`` (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, offs = byte_view(batch.column(column))
        at = 0
        while at < batch.num_rows:
            room = max(limit - size, 0)
            to = int(np.searchsorted(offs, offs[at] + room, side="right")) - 1
            if to <= at:
                if held:
                    yield _joined(held)
                    held, size = [], 0
                    continue
                to = at + 1
            to = min(to, batch.num_rows)
            held.append(batch.slice(at, to - at))
            size += int(offs[to] - offs[at]) + 64 * (to - at)
            at = to
            if size >= limit:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]


_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(texts: pa.Array, lower: bool = False) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(joined, starts, ends, first): the words between ASCII white space, end to end with one space after each.

    Word w is joined[starts[w]:ends[w]], so consecutive words of one text are one slice;
    text i has the words first[i] to first[i + 1]; ``lower`` folds A-Z.
    """
    data, offs = byte_view(texts)
    raw = np.insert(data, offs[1:], 0x20)  # so that texts never touch
    if lower:
        raw = np.frombuffer(raw.tobytes().translate(_ASCII_LOWER), np.uint8)
    offs = offs + np.arange(len(offs))
    space = IS_SPACE[raw]
    if not len(raw):
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    closing = np.zeros(len(raw), bool)
    closing[1:] = space[1:] & ~space[:-1]
    first = np.searchsorted(np.flatnonzero(closing), offs)
    kept = ~space | closing
    ends = np.flatnonzero(closing[kept])
    joined = np.where(space, np.uint8(0x20), raw)[kept].tobytes()
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return joined, starts.astype(np.int64), ends.astype(np.int64), first


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of every range [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
