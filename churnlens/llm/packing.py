"""Hierarchical multi-length packing of tokenised documents.

Documents are dealt to groups by a hash of the row, so groups depend on the data alone.
Inside a group, blocks of at most ``BLOCK_TOKENS`` tokens are packed:

1. whole windows of the longest tier are cut off each document;
2. the rest of a document is routed to the smallest tier that holds it;
3. from the longest tier down, every piece opens a window of its tier, and the gap is
   filled with the longest pieces of shorter tiers that fit; what then stays open is
   filled by cutting one more piece, whose rest is routed anew;
4. pieces that open a window no shorter piece can fill are laid end to end into windows
   of the longest tier, and the very last rest into windows of powers of two.

So no sequence needs padding.  Finally the sequences of each tier are dealt to step
groups of equal token budget in serpentine order of attention cost (sum of squared
piece lengths), so that steps of a tier cost about the same.

Defined results: null text counts as empty, a document without text is its end id alone;
rows that repeat are packed as often as they occur; null ids sort first; an empty table
gives no rows; columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import begin_task, partitions_for, tokenizer_path, units
from churnlens.llm.tokens import _ENCODERS, encoder

TIERS = (2048, 1024, 512, 256, 128, 64)
BLOCK_TOKENS = 4 << 20
STEP_TOKENS = 64 << 10

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, sequence_tokens int, step_id long"


class _Pool:
    """Pieces by length; the longest one up to a bound is found with one mask."""

    def __init__(self, longest: int):
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.mask = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.by_length[length].append((doc, start))
        self.mask |= 1 << length

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``most`` tokens."""
        n = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < 1:
            return None
        doc, start = self.by_length[n].pop()
        if not self.by_length[n]:
            self.mask ^= 1 << n
        return doc, start, n


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (tier, [(document, start, length)]) for documents of these token counts.

    Every sequence is exactly as long as its tier; the last ones may have a tier that is
    any power of two.
    """
    top = max(tiers)
    rising = sorted(tiers)
    pools = {t: _Pool(t) for t in tiers}

    def route(doc: int, start: int, length: int) -> None:
        pools[next(t for t in rising if t >= length)].put(doc, start, length)

    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    for doc, n in enumerate(lengths):
        whole = n // top
        out.extend((top, [(doc, i * top, top)]) for i in range(whole))
        if n - whole * top:
            route(doc, whole * top, n - whole * top)

    rest: list[tuple[int, int, int]] = []
    for tier in reversed(rising):
        shorter = [t for t in reversed(rising) if t < tier]
        while piece := pools[tier].take(tier):
            window, gap = [piece], tier - piece[2]
            while gap:
                found = next((p for t in shorter if (p := pools[t].take(gap))), None)
                if not found:  # nothing fits whole: cut the shortest tier's longest piece
                    found = next((p for t in reversed(shorter) if (p := pools[t].take(t))), None)
                    if not found:
                        break
                    doc, start, n = found
                    route(doc, start + gap, n - gap)
                    found = (doc, start, gap)
                window.append(found)
                gap -= found[2]
            if gap:
                rest.extend(window)
            else:
                out.append((tier, window))

    window, room = [], top
    left = sum(n for _, _, n in rest)
    sizes = [top] * (left // top) + [1 << b for b in reversed(range(top.bit_length() - 1)) if (left % top) >> b & 1]
    at = iter(sizes)
    room = size = next(at, 0)
    for doc, start, n in rest:
        while n:
            took = min(n, room)
            window.append((doc, start, took))
            start, n, room = start + took, n - took, room - took
            if not room:
                out.append((size, window))
                window, room = [], (size := next(at, 0))
    return out


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], budget: int = STEP_TOKENS) -> list[int]:
    """A step number for each sequence: steps hold sequences of one tier and about equal attention cost."""
    steps, base = [0] * len(sequences), 0
    for tier in sorted({t for t, _ in sequences}, reverse=True):
        own = [i for i, (t, _) in enumerate(sequences) if t == tier]
        own.sort(key=lambda i: -sum(n * n for _, _, n in sequences[i][1]))
        groups = max(1, round(len(own) * tier / budget))
        for k, i in enumerate(own):
            lap, place = divmod(k, groups)
            steps[i] = base + (groups - 1 - place if lap % 2 else place)
        base += groups
    return steps


def pack_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text",
                   tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit) and its place in a sequence."""
    path = path or tokenizer_path()
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartition(partitions_for(rows), F.xxhash64("doc_id", "text")).sortWithinPartitions("doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made = [0, 0]  # sequences and steps so far
        begin_task(_ENCODERS)
        ids, docs_in, counts = [], [], []

        def packed() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(ids).astype("<u4")
            lengths = np.concatenate(counts)
            doc_ids = pa.chunked_array(docs_in).combine_chunks()
            sequences = pack_lengths(lengths.tolist(), tiers)
            steps = step_groups(sequences)
            size = np.fromiter((len(w) for _, w in sequences), np.int64, len(sequences))
            doc, start, length = np.array([p for _, w in sequences for p in w], dtype=np.int64).reshape(-1, 3).T
            tier = np.repeat(np.fromiter((t for t, _ in sequences), np.int32, len(sequences)), size)
            number = np.repeat(np.arange(len(sequences)) + (made[0] | part << 32), size)
            before = np.cumsum(length) - length
            offset = before - np.repeat(before[np.cumsum(size) - size], size)
            step = np.repeat(np.array(steps, dtype=np.int64) + (made[1] | part << 32), size)
            begin = (np.cumsum(lengths) - lengths)[doc] + start
            made[0] += len(sequences)
            made[1] += max(steps, default=-1) + 1
            some = 8192
            for i in range(0, len(doc), some):
                s = slice(i, i + some)
                raw = [flat[a : a + n].tobytes() for a, n in zip(begin[s].tolist(), length[s].tolist())]
                columns = [doc_ids.take(pa.array(doc[s])), start[s], length[s], pa.array(raw, pa.binary()), lengths[doc[s]], number[s], offset[s], tier[s], tier[s], step[s]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])
            ids.clear(), docs_in.clear(), counts.clear()

        held = 0
        for unit in units(batches, "text"):
            tokens, offs = encoder(path).encode(unit.column("text"))
            ids.append(tokens)
            docs_in.append(unit.column("doc_id"))
            counts.append(np.diff(offs))
            held += len(tokens)
            if held >= BLOCK_TOKENS:
                yield from packed()
                held = 0
        if held:
            yield from packed()

    return rows.mapInArrow(task, PIECES)
