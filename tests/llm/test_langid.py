import numpy as np
import pyarrow as pa
import pytest

from churnlens.llm import langid
from tests.llm.helpers import documents

WORDS = {"aa": ["katu", "limo", "nari", "sopa"], "bb": ["thre", "owin", "gher", "plet"], "cc": ["zjvu", "xqor", "wkyl", "vbem"]}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang], n))


def plain(text, log_p, penalty):
    """Selected proportions by expectation-maximisation one trigram at a time, 4,000 rounds a fit."""
    grams, _ = langid.trigrams(pa.array([text]))
    k = log_p.shape[1]
    p = [np.exp(log_p[g] - log_p[g].max()) for g in grams]
    if not p:
        return np.zeros(k)

    def fit(allowed):
        w = np.array(allowed, float) / sum(allowed)
        for _ in range(4000):
            w = sum(x * w / (x @ w) for x in p) / len(p)
        return w, sum(np.log(x @ w) for x in p)

    single = sum(np.log(x) for x in p)
    allowed = [i == int(single.argmax()) for i in range(k)]
    weight, like = np.array(allowed, float), single.max()
    cost = penalty * np.log(len(p) + 1)
    full, most = fit([True] * k)
    if most - like <= cost:
        return weight
    for _ in range(k - 1):
        nxt = max((i for i in range(k) if not allowed[i]), key=lambda i: full[i])
        trial = [a or i == nxt for i, a in enumerate(allowed)]
        w, l = fit(trial)
        if l - like <= cost:
            break
        allowed, weight, like = trial, w, l
    return weight


def test_mixtures_equal_a_plain_fit():
    rng = np.random.default_rng(4)
    names = sorted(WORDS)
    model = np.full((langid.BUCKETS, 3), 0.5)
    for k, name in enumerate(names):
        grams, _ = langid.trigrams(pa.array([prose(rng, name, 300)]))
        model[:, k] += np.bincount(grams, minlength=langid.BUCKETS)
    log_p = np.log(model / model.sum(axis=0))
    texts = ["", "12 34", prose(rng, "aa", 1), prose(rng, "bb", 12), prose(rng, "aa", 6) + " " + prose(rng, "bb", 9), "katu thre",
             " ".join(prose(rng, x, 5) for x in names), "unknown words entirely", prose(rng, "cc", 20) + " katu", "limo limo limo limo owin"]
    grams, offs = langid.trigrams(pa.array(texts))
    got = langid.mixtures(grams, offs, log_p)
    for text, row in zip(texts, got):
        want = plain(text, log_p, langid.PENALTY)
        assert ((row > 0) == (want > 0)).all(), text
        assert np.abs(row - want).max() < 0.03, text
    alone = [langid.mixtures(*langid.trigrams(pa.array([t])), log_p)[0] for t in texts]
    assert np.allclose(got, alone, atol=1e-5)  # a text's result does not depend on its neighbours


def test_long_ties_repeated_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, prose(rng, "aa" if i % 2 else "bb", 40)) for i in range(60)]
    long = prose(rng, "aa", 250_000)
    every = [*rows, *rows[:5], (100, long), (101, None), (102, "..."), (None, "katu limo"), (103, "qqq")]
    docs = documents(spark, every, extra=("kept", "score", "langs")).withColumn("lang", __import__("pyspark").sql.functions.expr("CASE WHEN doc_id < 60 THEN if(doc_id % 2 = 1, 'aa', 'bb') END"))
    got = langid.identify(docs).collect()
    assert len(got) == len(every)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, _ in rows:
        assert {r.lang_pred for r in by[i]} == {"aa" if i % 2 else "bb"} and len({(r.score, str(r.langs)) for r in by[i]}) == 1
    assert by[100][0].lang_pred == "aa" and by[101][0].lang_pred == by[102][0].lang_pred == "und" and by[101][0].score == 0.0
    assert by[None][0].lang_pred == "aa" and 0 <= by[103][0].score <= 1


@pytest.mark.parametrize("label", [None, "aa"])
def test_no_or_one_language(spark, label):
    from pyspark.sql import functions as F

    docs = documents(spark, [(1, "katu limo"), (2, "nari")]).withColumn("lang", F.lit(label).cast("string"))
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {label or "und"}
