"""Language identification as inference of a mixture of languages.

Training counts hashed letter trigrams (lower-cased UTF-8 bytes, other bytes folded to one
space) per language over all training documents; tasks add up their own counts before the
shuffle, and the model is a table of ``BUCKETS`` by languages, a size fixed by the parameter
and the number of languages.  A document's language proportions are estimated by expectation
maximisation over its trigrams.  The language set is grown greedily from the best single
language while the log-likelihood gains more than ``PENALTY`` * log(trigrams) per language.

Defined results: null text or text without a letter is ``und`` with score 0; so is every text
if no language could be learnt; repeated rows get equal results; an empty table gives no
rows; language, source and id are never inputs of a prediction; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import begin_task, byte_view, units

BUCKETS = 1 << 16
PENALTY = 1.0
#: A fit ends where no proportions can raise the log-likelihood by more than this share of the penalty.
CLOSE = 0.01
#: What a text's sums of single-precision numbers can be trusted to, as a share of its trigrams.
EXACT = 1e-6
UNIT_BYTES = 1 << 20
UNKNOWN = "und"
LETTER = r"\p{L}"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every trigram that holds a letter, offsets per text); the text is framed by spaces."""
    data, offs = byte_view(texts)
    n = len(offs) - 1
    at = np.concatenate([offs[:-1], offs[1:]])
    order = np.argsort(at, kind="stable")
    b = np.insert(_FOLD[data], at[order], 0x20)  # one space before and one after each text
    first = offs[:-1] + 2 * np.arange(n)
    if len(b) < 3:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    x = b.astype(np.uint32)
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    code = ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
    use = (b[1:-1] != 0x20)
    before = np.concatenate([[0], np.cumsum(use)])
    return code[use], before[np.minimum(np.append(first, len(b)), len(use))]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [BUCKETS, languages]) from all rows with a language."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        begin_task()
        for unit in units(batches, "text", UNIT_BYTES):
            grams, offs = trigrams(unit.column("text"))
            names = np.array(unit.column("lang").to_pylist(), object)
            owner = np.repeat(np.arange(len(names)), np.diff(offs))
            for name in set(names):
                own = np.bincount(grams[(names == name)[owner]], minlength=BUCKETS)
                counts[name] = counts.get(name, 0) + own
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(own[at].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(LETTER)).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    total = rows.mapInArrow(task, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(total.column("lang").to_pylist()))
    model = np.full((BUCKETS, len(names)), 0.5)
    place = {x: i for i, x in enumerate(names)}
    if names:
        code = total.column("lang").combine_chunks().dictionary_encode()
        to = np.array([place[x] for x in code.dictionary.to_pylist()])
        model[total.column("bucket").to_numpy(), to[code.indices.to_numpy()]] += total.column("n").to_numpy()
    return names, np.log(model / model.sum(axis=0))


def mixtures(grams: np.ndarray, offs: np.ndarray, log_p: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of each text, zero outside its selected set.

    A text's distinct trigrams are counted first.  The log-likelihood is concave in the proportions, so
    its value and its steepest slope at any point bound what any proportions can reach.  Rounds of
    expectation-maximisation over all languages end for a text as soon as that bound shows that no set
    can pay for its penalty, or that the proportions are as good as the best ones.
    """
    n, k = len(offs) - 1, log_p.shape[1]
    sizes = np.diff(offs)
    live = np.flatnonzero(sizes > 0)
    out = np.zeros((n, k))
    if not len(live) or not k:
        return out
    size = sizes[live].astype(np.float64)
    key, times = np.unique(np.repeat(np.arange(len(live)), sizes[live]) * len(log_p) + grams, return_counts=True)
    owner, bucket = key // len(log_p), key % len(log_p)
    times = times.astype(np.float32)
    starts = np.searchsorted(owner, np.arange(len(live)))
    # scaled so that each trigram's likeliest language has 1: proportions do not depend on it
    scaled = log_p - log_p.max(axis=1, keepdims=True)
    p = np.exp(scaled).astype(np.float32)[bucket]
    cost = penalty * np.log(size + 1.0)

    def fitted(allowed: np.ndarray, docs: np.ndarray, beaten: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood of the texts ``docs`` under their ``allowed`` languages.

        With ``beaten``, a text also ends once its log-likelihood cannot exceed that much.
        """
        weight = allowed / allowed.sum(axis=1, keepdims=True)
        like = np.full(len(docs), -np.inf)
        left = np.arange(len(docs))
        while len(left):
            mine = np.zeros(len(live), bool)
            mine[docs[left]] = True
            some = mine[owner]
            rows, count = p[some], times[some]
            own = (np.cumsum(mine) - 1)[owner[some]]
            cut = np.searchsorted(own, np.arange(len(left)))
            total, here, fit = size[docs[left]], allowed[left], weight[left]
            going = np.ones(len(left), bool)
            # rounds go on until half of these texts have ended; then the others are taken out
            while going.sum() * 2 > len(left):
                mix = np.einsum("ij,ij->i", rows, fit.astype(np.float32)[own])
                np.maximum(mix, 1e-30, out=mix)
                slope = np.add.reduceat(rows * (count / mix)[:, None], cut, axis=0, dtype=np.float64)
                now = np.add.reduceat(np.log(mix) * count, cut, dtype=np.float64)
                gap = np.where(here, slope, 0.0).max(axis=1) - total
                end = gap <= np.maximum(CLOSE * cost[docs[left]], EXACT * total)
                if beaten is not None:
                    end |= now + gap <= beaten[left]
                end &= going
                weight[left[end]], like[left[end]] = fit[end], now[end]
                going &= ~end
                fit = np.where(going[:, None], fit * slope / total[:, None], fit)
            weight[left] = fit
            left = left[going]
        return weight, like

    single = np.add.reduceat(scaled.astype(np.float32)[bucket] * times[:, None], starts, axis=0, dtype=np.float64)
    best = single.argmax(axis=1)
    allowed = np.zeros((len(live), k), bool)
    allowed[np.arange(len(live)), best] = True
    weight, like = allowed.astype(np.float64), single.max(axis=1)
    full, most = fitted(np.ones((len(live), k), bool), np.arange(len(live)), like + cost)
    open_ = np.flatnonzero(most - like > cost)  # no larger set can pay for itself elsewhere
    for _ in range(k - 1):
        if not len(open_):
            break
        trial = allowed[open_]
        nxt = np.where(trial, -1, full[open_]).argmax(axis=1)
        trial[np.arange(len(open_)), nxt] = True
        w, l = fitted(trial, open_)
        gain = l - like[open_] > cost[open_]
        done = open_[gain]
        allowed[done], weight[done], like[done] = trial[gain], w[gain], l[gain]
        open_ = done
    out[live] = weight
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns with lang_pred, score and langs (language -> proportion)."""
    names, log_p = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(log_p)
    keep = keep or []
    # the columns travel under numbered names, so that they cannot clash
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(LETTER), F.lit(False)).alias("letters"))
    kept = rows.schema["kept"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*names, UNKNOWN], object)
        begin_task()
        for unit in units(batches, "text", UNIT_BYTES):
            grams, offs = trigrams(unit.column("text"))
            w = mixtures(grams, offs, shared.value)
            known = unit.column("letters").to_numpy(zero_copy_only=False).astype(bool) & (w.sum(axis=1) > 0)
            top = w.argmax(axis=1) if names else np.zeros(len(w), int)
            score = np.where(known, w.max(axis=1) if names else 0.0, 0.0)
            sets = [[(names[j], float(r[j])) for j in np.flatnonzero(r)] if ok else [] for r, ok in zip(w, known)]
            yield pa.RecordBatch.from_arrays(
                [unit.column("kept"), pa.array(labels[np.where(known, top, len(names))], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(sets, pa.map_(pa.string(), pa.float64()))],
                names=["kept", "lang_pred", "score", "langs"])

    return rows.mapInArrow(task, f"kept {kept.simpleString()}, lang_pred string, score double, langs map<string,double>").select("kept.*", "lang_pred", "score", "langs")


def fold(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs; learnt from the documents that are not held out."""
    held = fold(doc_id, 4) == 2
    model = train(docs.where(~held), text, lang)
    found = predict(docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text")), model, "text", ["doc_id", "held_out"])
    return found
