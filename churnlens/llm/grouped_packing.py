"""Best-fit packing of tokenised documents by linear grouping.

Documents are dealt to tasks by a hash of the row (a number of tasks that follows from the bytes of
text alone), and each task packs blocks of ``BLOCK_TOKENS`` tokens:

1. documents longer than a sequence are cut into whole sequences, the first piece taking the rest;
2. pieces longer than ``SMALL`` of a sequence are sorted and cut into groups of equal cardinality,
   and each length is rounded up to its group's longest;
3. for these few sizes the cheapest mix of configurations (sizes that fill one sequence) is found by
   column generation over the linear program; whole parts of the solution are taken;
4. actual documents take the places of the rounded ones, longest first;
5. what is left over of the large pieces and all small ones go, longest first, to the fullest
   sequence that still has room, or open a new one.

Defined results: null text counts as empty, a document without text is its end id alone; rows that
repeat are packed as often as they occur; null ids sort first; ties in length are taken in order of
id and text; very long texts are encoded in slices and cut like any other, their ids are held by one
task; an empty table gives no rows; columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.byte_tokens import piece_encoder
from churnlens.llm.common import partitions_for, tokenizer_path, units

CAPACITY = 2048
BLOCK_TOKENS = 12 << 20
#: Pieces up to this share of a sequence are small.
SMALL = 1 / 3
#: Groups of equal cardinality, and so at most as many sizes.
GROUPS = 192

#: The linear program is solved to this relative distance from its optimum.
GAP = 1e-3

PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def cut_documents(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of every piece; only a document's first piece may be short."""
    count = -(-lengths // capacity)
    doc = np.repeat(np.arange(len(lengths)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = lengths - (count - 1) * capacity
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first[doc], capacity)


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size occurs in the configuration of the greatest worth (a knapsack over the capacity)."""
    best = np.zeros(capacity + 1)
    steps = []
    for i, size in enumerate(sizes.tolist()):
        for _ in range(capacity // size):
            better = best[:-size] + worth[i] > best[size:] + 1e-12
            if not better.any():
                break
            best[size:][better] = best[:-size][better] + worth[i]
            steps.append((i, size, better))
            best = best.copy()
    found, room = np.zeros(len(sizes)), capacity
    for i, size, better in reversed(steps):
        if room >= size and better[room - size]:
            found[i] += 1
            room -= size
    return found


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how often each size occurs, how many sequences) in whole parts of the optimal mix; never more than the demand."""
    basis = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(basis)
    for _ in range(40 * len(sizes)):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        new = _best_configuration(sizes, worth, capacity)
        # the optimum is at least the amount so far over the new configuration's worth
        if new @ worth <= 1 + GAP:
            break
        change = np.linalg.solve(basis, new)
        limit = np.full(len(sizes), np.inf)
        np.divide(amount, change, out=limit, where=change > 1e-9)
        out = int(limit.argmin())
        amount = np.maximum(amount - limit[out] * change, 0)
        amount[out] = limit[out]
        basis[:, out] = new
    left, chosen = demand.astype(np.int64), []
    for j in range(len(sizes)):
        used = basis[:, j].astype(np.int64)
        times = min(int(amount[j] + 1e-6), *(left[used > 0] // used[used > 0]).tolist()) if used.any() else 0
        if times > 0:
            left = left - times * used
            chosen.append((used, times))
    return chosen


def pack(lengths: np.ndarray, capacity: int = CAPACITY, small: float = SMALL, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """(sequence of each piece, number of sequences) for pieces of at most ``capacity`` tokens."""
    where = np.full(len(lengths), -1, np.int64)
    full = np.flatnonzero(lengths == capacity)
    where[full] = np.arange(len(full))
    made = len(full)
    by_length = np.argsort(-lengths, kind="stable")
    by_length = by_length[lengths[by_length] < capacity]
    large = by_length[lengths[by_length] > capacity * small]
    room: list[int] = []  # of the sequences after the full ones
    if len(large):
        parts = np.array_split(large, min(groups, len(large)))
        rounded = np.repeat([lengths[p[0]] for p in parts], [len(p) for p in parts])
        sizes, begin, demand = np.unique(-rounded, return_index=True, return_counts=True)
        sizes = -sizes
        taken = begin.copy()
        for used, times in configurations(sizes, demand, capacity):
            space = np.full(times, capacity, np.int64)
            for i in np.flatnonzero(used).tolist():
                n = int(used[i])
                some = large[taken[i] : taken[i] + n * times].reshape(n, times)
                # lay alternate rows the other way round, so that long and short ones meet
                some[1::2] = some[1::2, ::-1]
                where[some] = made + len(room) + np.arange(times)
                space -= lengths[some].sum(axis=0)
                taken[i] += n * times
            room.extend(space.tolist())
    # the fullest sequence with enough room is found by one mask over the amounts of room
    holders: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k, r in enumerate(room):
        holders[r].append(k)
        mask |= 1 << r
    for i in by_length[where[by_length] < 0].tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            k = holders[r].pop()
            if not holders[r]:
                mask ^= 1 << r
        else:
            k, r = len(room), capacity
            room.append(r)
        where[i] = made + k
        holders[r - n].append(k)
        mask |= 1 << (r - n)
    return where, made + len(room)


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit) and its place in a sequence."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartition(partitions_for(rows), F.xxhash64("doc_id", "text")).sortWithinPartitions("doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[pa.Array] = []
        counts: list[np.ndarray] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal made
            flat, of_doc, doc_ids = np.concatenate(ids).astype("<u4", copy=False), np.concatenate(counts), pa.chunked_array(names).combine_chunks()
            ids.clear(), names.clear(), counts.clear()
            doc, piece, start, length = cut_documents(of_doc, capacity)
            where, number = pack(length, capacity)
            order = np.lexsort((doc, where))
            before = np.cumsum(length[order]) - length[order]
            opens = np.concatenate([[True], np.diff(where[order]) > 0])
            offset = before - before[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
            begin = (np.cumsum(of_doc) - of_doc)[doc] + start
            for i in range(0, len(order), 8192):
                o = order[i : i + 8192]
                raw = [flat[a : a + n].tobytes() for a, n in zip(begin[o].tolist(), length[o].tolist())]
                columns = [doc_ids.take(pa.array(doc[o])), pa.array(piece[o], pa.int32()), pa.array(start[o]), pa.array(length[o]), pa.array(raw, pa.binary()),
                           pa.array(where[o] + made + (part << 32)), pa.array(offset[i : i + 8192])]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PIECES.split(", ")])
            made += number

        held = 0
        for unit in units(batches, "text"):
            tokens, offs = piece_encoder(path, end_id).encode(unit.column("text"))
            ids.append(tokens), names.append(unit.column("doc_id")), counts.append(np.diff(offs))
            held += len(tokens)
            if held >= BLOCK_TOKENS:
                yield from packed()
                held = 0
        if held:
            yield from packed()

    return rows.mapInArrow(task, PIECES)
