import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlens.llm import resampling
from tests.llm.helpers import ODD_ROWS, documents, prose

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def features_of(text, grams):
    words = WORD.findall((text or "").encode().translate(FOLD))
    return [b" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, grams=1, buckets=10_000, percent=10, min_words=20):
    """Rows (doc_id, n_features, weight, score), and the ids and scores of the draw in order."""
    code = lambda f: zlib.crc32(f) % buckets
    s = Counter(code(f) for _, t in rows for f in features_of(t, grams))
    t = Counter(code(f) for x in target for f in features_of(x, grams))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out, able = [], []
    for i, text in rows:
        f = features_of(text, grams)
        weight = sum(gain[code(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(f), weight, score))
        if len(features_of(text, 1)) >= min_words:
            able.append((-score, i is None, i or 0))
    return out, [(i if not none else None, -s) for s, none, i in sorted(able)[: len(able) * percent // 100]]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def check(spark, rows, target, grams, **options):
    docs = documents(spark, rows, extra=("n_words", "weight", "bucket"))
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, wanted, grams=grams, **options).collect()
    every, drawn = brute(rows, target, grams, **options)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(every, key=key)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == drawn


@pytest.mark.parametrize("grams", [1, 3])
def test_against_brute_force(spark, grams):
    rows = [*ODD_ROWS, *((100 + i, prose(i, i % 70)) for i in range(300))]
    check(spark, rows, [prose(7, 300), "", None, "hello world"], grams, buckets=500, percent=30)


def test_hot_copies_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 10)
    rows = [(5, prose(1, 40))] * 150 + [(None, prose(2, 30))] * 50 + [(i, prose(i, 25)) for i in range(200)]
    check(spark, rows, [prose(3, 200)], 1, percent=60)


def test_empty_tables(spark):
    check(spark, [], ["some target"], 1)
    check(spark, [(1, prose(1, 50)), (2, None)], [], 1, percent=100)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é9\n.- \xff")), max_size=6), st.integers(1, 3), st.integers(1, 12))
def test_slices_lose_and_repeat_nothing(texts, grams, size):
    was, resampling.SLICE_BYTES = resampling.SLICE_BYTES, size
    try:
        found = Counter()
        for doc, n, bucket in resampling.features(pa.array(texts, pa.string()), resampling._Buckets(1 << 30), grams):
            found.update(zip(doc.tolist(), n.tolist(), bucket.tolist()))
    finally:
        resampling.SLICE_BYTES = was
    want = Counter((i, f.count(b" ") + 1, zlib.crc32(f) % (1 << 30)) for i, t in enumerate(texts) for f in features_of(t, grams))
    assert found == want


def test_very_long_text(spark):
    text = prose(3, 1_500_000)
    assert len(text) > 2 * resampling.SLICE_BYTES
    check(spark, [(1, text), (2, "x" * (resampling.SLICE_BYTES + 10)), (3, prose(1, 30))], [prose(2, 100)], 2, percent=100)
