"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel.

The kernel compares words by their common three-letter subsequences: an occurrence that spans
s characters weighs ``DECAY`` ** s, spans up to ``SPAN``, normalised to 1 for equal words, so an
insult with inserted or dropped characters stays close to the plain one; punctuation at a word's
edges does not count.  A worker works out a distinct word's kernel values once.  Landmarks are words of
the training documents: those whose document frequency differs most between the classes, chosen
by counts over all training rows.  Alike words give one landmark. A document is described by its
greatest and its mean (fourth power) kernel value with each landmark, whitened by the inverse root of the landmarks' own kernel matrix (Nystrom), and scored
by a linear machine trained with the squared hinge; a logistic curve fitted on the margins of
the training rows turns margins into scores.

The machine is fitted on at most ``FIT_ROWS`` labelled training rows (a documented bound): of each
class those with the least hash of id and text (equal ones as they come), half of the bound or what the other class leaves;
rows are weighted by their class's share of all training rows.  Word counts use all of them.

Defined results: null and empty text describe as zeros and get the score of that vector;
rows without a label never train; of contradicting labels of one id the greatest holds; with one class only, or none, every score is that class's
rate (0 if none); repeated rows score alike; an empty table gives no rows; labels, language,
source and id are never inputs of a score; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import WORKER_CACHES, begin_task, expand, materialised, units, words_of
from churnlens.llm.langid import fold

DECAY = 0.7
SPAN = 7
LANDMARKS = 64
FIT_ROWS = 20_000
RIDGE = 1e-4
#: Longest piece of a word compared at once; a longer word is read in overlapping pieces.
PIECE = 24
_CODE = np.zeros(256, np.int64)
_CODE[0x61:0x7B] = np.arange(1, 27)
_CODE[0x30:0x3A] = 27
_CODE[0x80:] = 28 + np.arange(128) % 35
#: Marks the beginning and the end of a word.
_CODE[0x20] = 63
SYMBOLS = 64
#: Punctuation at the edges of a word is not the word's; that within it is.
EDGES = b" .,;:!?\"'()"
#: Distinct words whose kernel values a worker remembers before it starts anew, and their greatest length.
REMEMBERED = 200_000
REMEMBERED_BYTES = 48
#: Words whose kernel values are worked out at once.
SOME_WORDS = 4096
#: Words looked at for each landmark taken, and the kernel value above which two are too alike.
CANDIDATES = 20
ALIKE = 0.7
_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


#: Weight of an occurrence by the distance of its last character from its first.
_WEIGHT = DECAY ** (np.arange(8) + 1.0)


def subsequences(codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(start positions, subsequence numbers, distance of the ends) for each gap pattern; symbols of code 0 never match."""
    n = len(codes)
    at = np.arange(n)
    for a, b in _GAPS:
        i = at[: max(n - b, 0)][at[b:] < ends[: max(n - b, 0)]]
        x, y, z = codes[i], codes[i + a], codes[i + b]
        good = (x > 0) & (y > 0) & (z > 0)
        yield i[good], ((x * SYMBOLS + y) * SYMBOLS + z)[good], b


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, end position per symbol, word number per piece start array) of lower-cased words, pieced."""
    cut, owner = [], []
    for w, word in enumerate(words):
        word = b" " + word + b" "
        for i in range(0, max(len(word) - PIECE // 2, 1), PIECE // 2):
            cut.append(word[i : i + PIECE])
            owner.append(w)
    lengths = np.array([len(c) for c in cut], np.int64)
    codes = _CODE[np.frombuffer(b"".join(cut), np.uint8)]
    return codes, lengths, np.array(owner, np.int64)


def kernel(words: list[bytes], table: tuple, norm: np.ndarray) -> np.ndarray:
    """Normalised kernel of each word with each landmark, the greatest over the word's pieces."""
    codes, lengths, owner = pieces(words)
    index, begin, column, value = table
    m = len(norm)
    ends = np.repeat(np.cumsum(lengths), lengths)
    piece = np.repeat(np.arange(len(lengths)), lengths)
    # one number holds piece, subsequence and span, so that a plain sort groups them
    keys = [(piece[at] * SYMBOLS**3 + sub) * 8 + span for at, sub, span in subsequences(codes, ends)]
    key = np.sort(np.concatenate(keys))
    k = np.zeros((len(lengths), m), np.float32)
    if len(key):
        new = np.flatnonzero(np.diff(key >> 3, prepend=-1))
        weight, key = np.add.reduceat(_WEIGHT[key & 7], new), key[new] >> 3
        own, row = key // SYMBOLS**3, index[key % SYMBOLS**3]
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        size = np.ones(len(lengths))
        size[own[cut]] = np.sqrt(np.add.reduceat(weight * weight, cut))
        shared = row > 0
        own, row, weight = own[shared], row[shared], weight[shared]
        # few landmarks hold a subsequence: their products are added place by place
        times = begin[row + 1] - begin[row]
        at = expand(begin[row], times)
        dots = np.bincount(np.repeat(own, times) * m + column[at], np.repeat(weight, times) * value[at], len(lengths) * m)
        k = (dots.reshape(-1, m) / size[:, None] / norm).astype(np.float32)
    if len(owner) == len(words):
        return k
    return np.maximum.reduceat(k, np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)


def landmark_table(landmarks: list[bytes]) -> tuple[tuple, np.ndarray]:
    """((row of each subsequence, 0 for those of no landmark; begin of each row's cells; their landmarks; their weights), norms)."""
    number, column, weight = [], [], []
    for j, word in enumerate(landmarks):
        codes, _, _ = pieces([word[: PIECE - 2]])
        codes = codes[:PIECE]
        for _, sub, span in subsequences(codes, np.full(len(codes), len(codes))):
            number.append(sub), column.append(np.full(len(sub), j)), weight.append(np.full(len(sub), _WEIGHT[span]))
    number, column, weight = np.concatenate(number), np.concatenate(column), np.concatenate(weight)
    cells, at = np.unique(number * len(landmarks) + column, return_inverse=True)
    weight = np.bincount(at, weight, len(cells))
    used, first = np.unique(cells // len(landmarks), return_index=True)
    index = np.zeros(SYMBOLS**3, np.int32)
    index[used] = np.arange(1, len(used) + 1)
    begin = np.concatenate([[0], first, [len(cells)]])
    column = cells % len(landmarks)
    norm = np.sqrt(np.bincount(column, weight * weight, len(landmarks)))
    return (index, begin, column, weight), np.maximum(norm, 1e-9)


class WordKernels:
    """Kernel values of words with the landmarks, each distinct word worked out once per worker."""

    def __init__(self, table: tuple, norm: np.ndarray):
        self.table, self.norm = table, norm
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.values = np.zeros((1 << 12, len(self.norm)), np.float32)

    def _computed(self, words: list[bytes]) -> np.ndarray:
        parts = [kernel(words[i : i + SOME_WORDS], self.table, self.norm) for i in range(0, len(words), SOME_WORDS)]
        return np.concatenate(parts) if parts else self.values[:0]

    def of(self, words: list[bytes]) -> np.ndarray:
        """A row of kernel values for each of the distinct ``words``; long words are not remembered."""
        short = [w for w in words if len(w) <= REMEMBERED_BYTES]
        if len(self.known) + len(short) > REMEMBERED:
            self.forget()
        new = [w for w in short if w not in self.known]
        if len(new) + len(self.known) > REMEMBERED:
            return self._computed(words)
        if new:
            n = len(self.known)
            while n + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.values[n : n + len(new)] = self._computed(new)
            self.known.update(zip(new, range(n, n + len(new))))
        if len(short) == len(words):
            return self.values[[self.known[w] for w in words]]
        out = np.empty((len(words), self.values.shape[1]), np.float32)
        kept = np.array([len(w) <= REMEMBERED_BYTES for w in words])
        out[kept] = self.values[[self.known[w] for w in short]]
        out[~kept] = self._computed([w for w in words if len(w) > REMEMBERED_BYTES])
        return out


_KERNELS: dict[bytes, WordKernels] = {}
WORKER_CACHES.append(_KERNELS)


def word_kernels(table: tuple, norm: np.ndarray) -> WordKernels:
    """The worker's kernel values for these landmarks, kept between tasks."""
    key = b"".join(part.tobytes() for part in (np.flatnonzero(table[0]), *table[1:]))
    if key not in _KERNELS:
        _KERNELS.clear()
        _KERNELS[key] = WordKernels(table, norm)
    return _KERNELS[key]


def coded_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct lower-cased words without punctuation at their edges, number of each occurrence's word, first occurrence by text)."""
    joined, starts, ends, first = words_of(texts, lower=True)
    if not len(starts):
        return [], np.zeros(0, np.int64), first
    bounds = np.append(starts, ends[-1] + 1).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(joined)]).dictionary_encode()
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(w.strip(EDGES), len(number)) for w in coded.dictionary.to_pylist()], np.int64)
    return list(number), of[coded.indices.to_numpy()], first


def describe(texts: pa.Array, kernels: WordKernels) -> np.ndarray:
    """For each text and landmark: the greatest kernel value of any word, then the root of the words' mean fourth power."""
    words, codes, first = coded_words(texts)
    m = len(kernels.norm)
    out = np.zeros((len(first) - 1, 2 * m), np.float32)
    if not words:
        return out
    values = kernels.of(words)
    # a text's distinct words once, with their counts
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs, counts = np.unique(doc * len(words) + codes, return_counts=True)
    doc, codes = pairs // len(words), pairs % len(words)
    cut = np.flatnonzero(np.diff(doc, prepend=-1))
    for lo in range(0, len(cut), 256):
        part = cut[lo : lo + 256]
        hi = cut[lo + 256] if lo + 256 < len(cut) else len(doc)
        some, at, of = codes[part[0] : hi], part - part[0], doc[part]
        v = values[some]
        out[of, :m] = np.maximum.reduceat(v, at, axis=0)
        sums = np.add.reduceat(np.square(np.square(v, out=v), out=v) * counts[part[0] : hi, None].astype(np.float32), at, axis=0)
        out[of, m:] = np.sqrt(sums / np.diff(first)[of][:, None])
    return out


def choose_landmarks(rows: DataFrame, most: int = LANDMARKS) -> list[bytes]:
    """Words whose share of documents differs most between the classes (signed root of chi-square)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for unit in units(batches, "text"):
            words, codes, first = coded_words(unit.column("text"))
            label = unit.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            n = max(len(words), 1)
            pairs = np.unique(np.repeat(np.arange(len(label)), np.diff(first)) * n + codes)
            word, bad = pairs % n, label[pairs // n]
            all_n, bad_n = np.bincount(word, minlength=n), np.bincount(word[bad == 1], minlength=n)
            taken = [i for i, w in enumerate(words) if 3 <= len(w) <= PIECE - 2]
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in taken], pa.binary()), pa.array((all_n - bad_n)[taken].astype(np.int64)), pa.array(bad_n[taken].astype(np.int64))], names=["word", "clean", "bad"])

    total = rows.groupBy().agg(F.sum(1 - F.col("toxic")).alias("c"), F.sum("toxic").alias("t")).first()
    c, t = max(total["c"] or 0, 1), max(total["t"] or 0, 1)
    share = F.expr(f"(bad / {t}D - clean / {c}D) / sqrt((bad + clean + 1) / {c + t}D)")
    counts = rows.select("text", "toxic").mapInArrow(task, "word binary, clean long, bad long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    best = counts.where("bad >= 2").withColumn("s", share).orderBy(F.desc("s"), "word").limit(most * CANDIDATES).collect()
    words = [bytes(r["word"]) for r in best]
    if not words:
        return []
    alike = np.concatenate([kernel(words, *landmark_table(words[i : i + 64])) for i in range(0, len(words), 64)], axis=1)
    taken: list[int] = []
    for i in range(len(words)):
        if len(taken) < most and (not taken or alike[i, taken].max() < ALIKE):
            taken.append(i)
    return [words[i] for i in taken]


def class_bounds(clean: int, bad: int, most: int) -> tuple[int, int]:
    """Rows of each class in a sample of ``most`` rows: half each, and what the smaller class leaves."""
    half = max(most // 2, 1)
    return min(clean, max(half, most - bad)), min(bad, max(most - half, most - clean, 1))


def least_hashes(rows: DataFrame, n: int) -> list[DataFrame]:
    """The ``n`` rows of least ``h``: those below the n-th, and as many equal to it as are wanted still."""
    # hashes alone are ordered: at most n numbers to a task
    last = rows.select("h").orderBy("h").limit(n).agg(F.max("h").alias("h")).first()["h"]
    below = rows.where(F.col("h") < last)
    return [below, rows.where(F.col("h") == last).limit(n - below.count())]


def train(rows: DataFrame, landmarks: int = LANDMARKS, fit_rows: int = FIT_ROWS) -> dict:
    """The model of labelled rows (doc_id, text, toxic)."""
    # written once: counts, words and sample read it, and none joins again
    rows = materialised(rows.where("toxic IN (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", "text").alias("h")), "toxicity-rows")
    total = rows.agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("bad")).first()
    counts = (total["clean"], total["bad"])
    words = choose_landmarks(rows, landmarks)
    model = {"landmarks": words, "weights": None, "rate": counts[1] / sum(counts) if sum(counts) else 0.0}
    if not words or not all(counts):
        return model
    table, norm = landmark_table(words)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(_KERNELS)
        kernels = word_kernels(table, norm)
        for unit in units(batches, "text", 1 << 20):
            x = describe(unit.column("text"), kernels)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), unit.column("toxic"), unit.column("h")], names=["x", "toxic", "h"])

    # least_hashes gives a bound by class, so the rows are found and described where they are
    parts = [part for c, n in enumerate(class_bounds(*counts, fit_rows)) for part in least_hashes(rows.where(F.col("toxic") == c), n)]
    sample = functools.reduce(DataFrame.unionByName, parts).mapInArrow(task, "x array<float>, toxic int, h long").toArrow().sort_by([("toxic", "ascending"), ("h", "ascending")])
    x, y = np.array(sample.column("x").to_pylist()), np.array(sample.column("toxic").to_pylist())
    taken = np.bincount(y, minlength=2)
    if not taken.all():
        raise ValueError(f"rows of one class only in the sample: {taken.tolist()} of {counts}")
    # what a row of the sample stands for, 1 on average
    stands = (np.array(counts) / taken * (len(y) / sum(counts)))[y]
    own = kernel(words, table, norm).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    m = len(words)
    z = np.hstack([x[:, :m] @ root, x[:, m:] @ root, np.ones((len(x), 1))])
    sign = 2.0 * y - 1
    share = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9)) / len(y)
    w = np.zeros(z.shape[1])
    ridge = np.diag([*[RIDGE] * (z.shape[1] - 1), 1e-9])
    for _ in range(50):  # Newton steps of the squared hinge
        inside = sign * (z @ w) < 1
        a = z[inside] * share[inside, None]
        new = np.linalg.solve(a.T @ z[inside] + ridge, a.T @ sign[inside])
        if np.allclose(new, w):
            break
        w = new
    margin, ab = z @ w, np.array([1.0, 0.0])
    for _ in range(50):  # logistic curve over the margins
        q = 1 / (1 + np.exp(-np.clip(ab[0] * margin + ab[1], -30, 30)))
        f = np.stack([margin, np.ones_like(margin)], axis=1)
        h = (f * (stands * q * (1 - q))[:, None]).T @ f + 1e-3 * np.eye(2)
        ab = ab + np.linalg.solve(h, f.T @ (stands * (y - q)) - 1e-3 * ab)
    return model | {"weights": np.concatenate([root @ w[:m], root @ w[m:-1], w[-1:]]), "curve": ab, "table": table, "norm": norm}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score) of rows (doc_id, held_out, text)."""
    if model["weights"] is None:
        return docs.select("doc_id", "held_out", F.lit(float(model["rate"])).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(_KERNELS)
        m = shared.value
        kernels = word_kernels(m["table"], m["norm"])
        for unit in units(batches, "text", 2 << 20):
            x = describe(unit.column("text"), kernels)
            margin = x @ m["weights"][:-1] + m["weights"][-1]
            s = 1 / (1 + np.exp(-np.clip(m["curve"][0] * margin + m["curve"][1], -30, 30)))
            yield pa.RecordBatch.from_arrays([unit.column("doc_id"), unit.column("held_out"), pa.array(s.astype(float))], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(task, f"doc_id {kind}, held_out boolean, score double")


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out documents are never read."""
    held = fold(doc_id, 5) == 0
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    known = labels.select(F.col(doc_id).alias("doc_id"), "toxic").where(~(fold("doc_id", 5) == 0)).where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # labels grow with the documents: both sides are shuffled at every size
    model = train(rows.where(~F.col("held_out") & F.col("text").isNotNull()).select("doc_id", "text").join(known.hint("merge"), "doc_id"))
    return score(rows, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
