"""Repeated word passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Consecutive windows that share a minimiser (the
least hash of their ``GRAM``-word parts) travel as one packed string to the minimiser's bucket,
in order of document and place, where each window is looked up among the windows of the same
minimiser, compared word for word: all but the first occurrence are marked, and
marked runs go back to their documents.  A task holds the distinct windows of one minimiser.

Defined results: null or blank text has no words; rows equal in id and text are one document;
a null id comes before all others, documents of one id are ordered by the hash of their
text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from churnlens.llm.common import words_of
from churnlens.llm.repeats import covered, cut, exchange, flag_runs, keyed, packed_runs

WINDOW = 20
GRAM = 6


def _runs(texts: pa.Array) -> tuple:
    """(text number, first window, windows, minimiser, places) of each run, and the function that packs runs."""
    joined, starts, ends, first = words_of(texts)
    if not len(starts):
        return *[np.zeros(0, np.int64)] * 5, lambda some: []
    bounds = np.append(starts, ends[-1] + 1).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(joined)]).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
    owner, at, count, least, places = packed_runs(hashes, first, WINDOW, GRAM)

    def pack(some: np.ndarray) -> list[bytes]:
        a, b = starts[at[some]].tolist(), ends[at[some] + count[some] + WINDOW - 2].tolist()
        return [joined[x:y] for x, y in zip(a, b)]

    return owner, at - first[owner], count, least, places, pack


def _judge(rows: Iterator[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """Marks every window met before in its minimiser's bucket."""
    for _, group in groupby(rows, key=lambda r: r[0]):
        seen: dict[bytes, tuple[int, int, int]] = {}
        for _, k1, k2, start, packed in group:
            words = packed.split(b" ")
            ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            begins = [0, *ends]
            flags = np.zeros(len(words) - WINDOW + 1, bool)
            for i in range(len(flags)):
                place = (k1, k2, start + i)
                flags[i] = seen.setdefault(packed[begins[i] : ends[i + WINDOW - 1] - 1], place) != place
            if flags.any():
                for i, n in flag_runs(flags):
                    yield k1, k2, start + i, n


_judge.order = ("k1", "k2", "start")


def remove_repeats(docs: DataFrame, columns: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``columns`` with n_words, n_removed, kept_text (kept words joined by one space) and its kept_sha256."""
    base = keyed(docs, columns or [doc_id], doc_id, text)

    def one(raw: bytes, found: list[dict] | None) -> tuple[int, int, str, str]:
        joined, starts, ends, _ = words_of(pa.array([raw], pa.binary()))
        gone = covered(found, len(starts), WINDOW)
        kept = b" ".join(joined[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist()))
        return len(starts), int(gone.sum()), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()

    return cut(base, exchange(base, _runs, _judge), one, "n_words long, n_removed long, kept_text string, kept_sha256 string")
