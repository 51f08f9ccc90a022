"""Repeated byte passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every ``WIDTH``-byte string meets its equals in the bucket of its minimiser (the least hash of
its ``GRAM``-byte parts), where consecutive strings of equal minimiser arrive as one packed string.
Equal packed strings are counted by sorting and marked as they stream by; the distinct
ones of one minimiser are laid end to end with separators of their own, and the transform
of that text is searched breadth first: the interval of the empty string is extended
backward, each new interval's right border gets the current depth as its common prefix if it has
none, and only such intervals are extended.  So common prefixes come out by increasing value and
the search stops at depth ``WIDTH``; borders without a value join suffixes that share at least
``WIDTH`` bytes, which are the repeats.

Defined results: null text is empty and nothing is removed from it; rows equal in id and text
are one document; the removed bytes may part a character (kept bytes are exact, the kept text drops
the rest of a parted character); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnlens.llm.common import byte_view, expand
from churnlens.llm.repeats import covered, cut, exchange, flag_runs, keyed, mixed, packed_runs

WIDTH = 200
GRAM = 32
#: Bytes of packed strings whose minimisers share one transform.
UNIT = 1 << 18

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def suffix_order(symbols: np.ndarray, width: int) -> np.ndarray:
    """The suffixes in order of their first ``width`` symbols or more, by prefix doubling of those still tied.

    Intervals of prefixes up to ``width`` are the same however longer ties are ordered.
    """
    n = len(symbols)
    base = int(symbols.max()) + 2
    step, key = 1, symbols + 1
    while step < width and base ** (step + 1) < 1 << 62:
        key = key * base
        key[: max(n - step, 0)] += symbols[step:] + 1
        step += 1
    order = np.argsort(key)
    rank, slots = np.empty(n, np.int64), np.arange(n)
    elements, key = order, key[order]
    while True:
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        rank[elements] = slots[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        tied = ~first
        tied[:-1] |= ~first[1:]
        slots = slots[tied]
        if step >= width or not len(slots):
            return order
        elements = order[slots]
        ahead = elements + step
        key = rank[elements] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        elements, key = elements[by], key[by]
        order[slots] = elements
        step *= 2


def long_prefixes(symbols: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): same[i] tells whether suffixes order[i - 1] and order[i] share ``width`` symbols or more."""
    n = len(symbols)
    order = suffix_order(symbols, width)
    before = symbols[order - 1]
    step = np.empty(n, np.int64)  # where the suffix one symbol longer stands
    step[np.argsort(before, kind="stable")] = np.arange(n)
    same = np.ones(n + 1, bool)
    same[[0, n]] = False
    low, high = np.array([0]), np.array([n])
    top = int(symbols.max()) + 1
    for _ in range(width):
        if not len(low):
            break
        size = high - low
        at = expand(low, size)
        key = np.repeat(np.arange(len(low)), size) * top + before[at]
        by = np.argsort(key, kind="stable")
        key = key[by]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        last = np.append(first[1:], len(key)) - 1
        lo, hi = step[at[by[first]]], step[at[by[last]]] + 1
        fresh = same[hi]
        # the last border of all takes part although it has a value
        fresh |= (hi == n) & (lo < n) & (hi - lo > 1)
        lo, hi = lo[fresh], hi[fresh]
        same[hi] = False
        low, high = lo, hi
    return order, same[:n]


def repeated_places(strings: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each string, which of its windows occur at another place of any of the strings."""
    k = len(strings)
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    symbols = raw.astype(np.int64) + k
    symbols[ends] = np.arange(k)
    order, same = long_prefixes(symbols, width)
    hit = np.zeros(len(symbols), bool)
    hit[order[same]] = True
    hit[order[np.flatnonzero(same) - 1]] = True
    return [hit[e - n : e - width + 1] for e, n in zip(ends.tolist(), sizes.tolist())]


def _runs(texts: pa.Array) -> tuple:
    """(text number, first window, windows, minimiser, places) of each run, and the function that packs runs."""
    data, offs = byte_view(texts)
    owner, at, count, least, places = packed_runs(_BYTES[data], offs, WIDTH, GRAM)

    def pack(some: np.ndarray) -> list[bytes]:
        raw = data.tobytes()
        return [raw[x:y] for x, y in zip(at[some].tolist(), (at[some] + count[some] + WIDTH - 1).tolist())]

    return owner, at - offs[owner], count, least, places, pack


def _may_repeat(s: bytes) -> bool:
    """Whether a string could hold one window twice: then its middle GRAM bytes come again within it."""
    windows = len(s) - WIDTH + 1
    if windows < 2:
        return False
    # two equal windows lie windows - 1 or fewer apart, so the part all windows cover has that period
    part = s[windows - 1 : WIDTH]
    return len(part) < GRAM or s.count(part[:GRAM]) > 1 or s.find(part[:GRAM], s.find(part[:GRAM]) + 1) >= 0


def _judge(rows: Iterator[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """Marks every window found at another place too."""
    held: list[tuple[bytes, tuple | None]] = []
    size = 0

    def searched() -> Iterator[tuple[int, int, int, int]]:
        for (_, place), flags in zip(held, repeated_places([s for s, _ in held])):
            if place is not None and flags.any():
                for i, n in flag_runs(flags):
                    yield place[0], place[1], place[2] + i, n

    for _, group in groupby(rows, key=lambda r: r[0]):
        distinct: list[tuple[bytes, tuple | None]] = []
        for packed, equal in groupby(group, key=lambda r: r[4]):
            n = len(packed) - WIDTH + 1
            place = next(equal)[1:4]
            last, several = place, False
            for r in equal:
                if r[1:4] != last:
                    if not several:
                        yield (*place, n)
                    several, last = True, r[1:4]
                    yield (*last, n)
            distinct.append((packed, None if several else place))
        if len(distinct) > 1 or distinct[0][1] is not None and _may_repeat(distinct[0][0]):
            held.extend(distinct)
            size += sum(len(s) for s, _ in distinct)
            if size >= UNIT:
                yield from searched()
                held, size = [], 0
    if held:
        yield from searched()


_judge.order = ("packed", "k1", "k2", "start")


def remove_repeats(docs: DataFrame, columns: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``columns`` with n_bytes, n_removed, n_spans, kept_text and the kept_sha256 of the kept bytes."""
    base = keyed(docs, columns or [doc_id], doc_id, text)

    def one(raw: bytes, found: list[dict] | None) -> tuple[int, int, int, str, str]:
        gone = covered(found, len(raw), WIDTH)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if found else raw
        return len(raw), int(gone.sum()), sum(1 for _ in flag_runs(gone)), kept.decode("utf-8", "ignore"), hashlib.sha256(kept).hexdigest()

    return cut(base, exchange(base, _runs, _judge), one, "n_bytes long, n_removed long, n_spans long, kept_text string, kept_sha256 string")
