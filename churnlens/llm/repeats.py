"""What the two passage-dedup operators share: windows sharing a minimiser travel together, marked runs come back.

A text is a row of symbols (words or bytes).  Every window of ``width`` symbols has a
minimiser, the least hash of its ``gram``-symbol parts; consecutive windows of equal
minimiser are one packed string.  Equal windows have equal minimisers, so they meet in
one bucket.

Only minimisers that occur at two places or more can hold a repeated window.  They are counted
first, as numbers (added up in each task before the shuffle), and go back to their documents;
only packed strings of those minimisers travel.  Both visits to the documents join on ``kk``, a
hash of id and text, over the same columns, so that Spark may use one shuffle of the texts for both;
documents that share a ``kk`` by chance are told apart by (k1, k2).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import PARTITION_BYTES, begin_task, expand, materialised, partitions_for, units

#: Stands for a null id, so that it sorts before all others.
NO_ID = -(1 << 62)
#: Most windows of one packed string.
LONGEST = 2048
#: Bytes of text looked at together: the arrays of a unit take some 50 bytes for each of them.
UNIT = 1 << 19
#: Bytes of packed strings for each byte of text, if all passages were repeated.
GROWTH = 3.5
PACKED = "minimiser long, k1 long, k2 long, start long, packed binary"


def keyed(docs: DataFrame, columns: list[str], doc_id: str, text: str) -> DataFrame:
    """(kept, kk, k1, k2, text): a document is known by its id and the hash of its text."""
    rows = docs.select(F.struct(*columns).alias("kept"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("k1"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k2"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.select("kept", F.xxhash64("k1", "k2").alias("kk"), "k1", "k2", "text")


def mixed(h: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def grams(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values, by doubling; the last width - 1 places are left out."""
    base = np.uint64(0x100000001B3)
    out, have = None, 0
    power, size = values, 1
    factor = base
    while True:
        if width & size:
            out = power if out is None else _joined(out, have, power, factor)
            have += size
        size *= 2
        if size > width:
            break
        power = power[: len(power) - size // 2] * factor + power[size // 2 :]
        factor = np.uint64(int(factor) ** 2 % (1 << 64))
    n = max(len(values) - width + 1, 0)
    return mixed(out[:n])


def _joined(left: np.ndarray, have: int, right: np.ndarray, factor: np.uint64) -> np.ndarray:
    n = min(len(left), len(right) - have)
    return left[: max(n, 0)] * factor + right[have : have + max(n, 0)]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:]) if len(values) > size else values[:0]
        size *= 2
    gap = width - size
    return np.minimum(values[: len(values) - gap], values[gap:]) if gap and len(values) > gap else values if not gap else values[:0]


def packed_runs(hashes: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, number of windows, minimiser, places of the minimiser) of each run.

    Text i has the symbols first[i] to first[i + 1].
    """
    none = np.zeros(0, np.int64)
    if len(hashes) < width:
        return none, none, none, none, none
    parts_of = grams(hashes, gram)
    span = width - gram + 1
    lowest = sliding_min(parts_of, span)
    least = lowest.view(np.int64)
    n = len(least)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    inside = np.arange(n) + width <= first[owner + 1]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]
    begins = np.flatnonzero(new & inside)
    if not len(begins):
        return none, none, none, none, none
    stops = np.append(np.flatnonzero(new | ~inside), n)
    count = stops[np.searchsorted(stops, begins, side="right")] - begins
    parts = -(-count // LONGEST)
    at = np.repeat(begins, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    count = np.minimum(np.repeat(begins + count, parts) - at, LONGEST)
    # a part is the minimiser of a window around it if it equals the greatest of their minimisers
    edge = np.zeros(span - 1, np.uint64)
    chosen = np.flatnonzero(~sliding_min(~np.concatenate([edge, lowest, edge]), span) == parts_of)
    lo, hi = np.searchsorted(chosen, at), np.searchsorted(chosen, at + count + span - 1)
    equal = parts_of[chosen[expand(lo, hi - lo)]] == np.repeat(lowest[at], hi - lo)
    places = np.add.reduceat(equal.astype(np.int64), np.cumsum(hi - lo) - (hi - lo))
    return owner[at], at, count, least[at], places


def repeated_minimisers(base: DataFrame, runs_of: Callable) -> DataFrame:
    """(kk, wanted): of each document, the minimisers that occur at two places or more of all texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for unit in units(batches, "text", UNIT):
            owner, _, _, least, places, _ = runs_of(unit.column("text"))
            order = np.lexsort((least, owner))
            owner, least, places = owner[order], least[order], places[order]
            new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(least, prepend=0) != 0))
            n = np.add.reduceat(places, new) if len(new) else places
            yield pa.RecordBatch.from_arrays([pa.array(least[new]), pa.array(unit.column("kk").to_numpy()[owner[new]]), pa.array(n)], names=["minimiser", "kk", "n"])

    seen = materialised(base.select("kk", "text").mapInArrow(task, "minimiser long, kk long, n long"), "minimisers")
    often = seen.groupBy("minimiser").agg(F.sum("n").alias("n")).where("n > 1").select("minimiser")
    return seen.select("minimiser", "kk").join(often, "minimiser").groupBy("kk").agg(F.collect_set("minimiser").alias("wanted"))


def exchange(base: DataFrame, runs_of: Callable, judge: Callable) -> DataFrame:
    """(kk, runs): marked runs (k1, k2, first window, number of windows) of the documents of each kk.

    ``runs_of`` gives the runs of a unit of texts and a function that packs some of them; packed strings
    meet by minimiser, sorted by minimiser and then as ``judge`` says, and ``judge`` yields (k1, k2, start, n).
    """
    n = partitions_for(base, "text", PARTITION_BYTES, GROWTH)

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for unit in units(batches, "text", UNIT):
            owner, start, _, least, _, pack = runs_of(unit.column("text"))
            some = np.flatnonzero(np.isin(least, unit.column("wanted").flatten().to_numpy()))
            k1, k2 = (unit.column(c).to_numpy()[owner[some]] for c in ("k1", "k2"))
            yield pa.RecordBatch.from_arrays([pa.array(least[some]), pa.array(k1), pa.array(k2), pa.array(start[some]), pa.array(pack(some), pa.binary())],
                                             names=["minimiser", "k1", "k2", "start", "packed"])

    suspects = base.join(repeated_minimisers(base, runs_of), "kk")
    met = suspects.mapInArrow(packing, PACKED).repartition(n, "minimiser").sortWithinPartitions("minimiser", *judge.order)

    def judging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        out: list[tuple[int, int, int, int]] = []
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("minimiser", "k1", "k2", "start", "packed"))))
        for mark in judge(rows):
            out.append(mark)
            if len(out) >= 1 << 16:
                yield _marks(out)
                out = []
        if out:
            yield _marks(out)

    marks = met.mapInArrow(judging, "k1 long, k2 long, start long, n long")
    return marks.groupBy(F.xxhash64("k1", "k2").alias("kk")).agg(F.collect_set(F.struct("k1", "k2", "start", "n")).alias("runs"))


def _marks(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["k1", "k2", "start", "n"])


def covered(runs: list[dict], symbols: int, width: int) -> np.ndarray:
    """Which symbols lie in a marked window."""
    edge = np.zeros(symbols + 1, np.int64)
    for r in runs or ():
        edge[r["start"]] += 1
        edge[r["start"] + r["n"] - 1 + width] -= 1
    return np.cumsum(edge)[:symbols] > 0


def flag_runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, length) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist())


def cut(base: DataFrame, runs: DataFrame, one: Callable, schema: str) -> DataFrame:
    """The kept columns of every row of ``base`` with what ``one(text bytes, runs)`` gives for it."""
    kind = base.schema["kept"].dataType
    joined = base.join(runs, "kk", "left")
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for unit in units(batches, "text", UNIT):
            keys = zip(*(unit.column(c).to_pylist() for c in ("k1", "k2")))
            own = [[r for r in found or () if (r["k1"], r["k2"]) == key] for key, found in zip(keys, unit.column("runs").to_pylist())]
            done = [one(t, r) for t, r in zip(unit.column("text").to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([unit.column("kept"), *[pa.array(list(c)) for c in zip(*done)]], names=["kept", *names])

    return joined.mapInArrow(task, f"kept {kind.simpleString()}, {schema}").select("kept.*", *names)
