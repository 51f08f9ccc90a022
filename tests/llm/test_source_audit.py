import re
from collections import Counter

import pytest

from churnlens.llm import source_audit
from tests.llm.helpers import prose

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, value long, `rank` string, vector string"


def brute(rows, min_df=3, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").encode().translate(FOLD))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= min_df}
        counts = {}
        for _, source, words in own:
            counts.setdefault(source, Counter()).update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        apart = lambda p, q: (p - q) ** 2 // q
        for a, c in counts.items():
            pairs = [(sum(apart(share(c, w), share(d, w)) for w in kept), b.encode()) for b, d in counts.items() if b != a]
            terms = [(apart(share(c, w), share(whole, w)), w) for w in c if c[w] and share(c, w) > share(whole, w)]
            for part, items in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1]))[:top])):
                out += [(lang, a, part, item.decode(), value, k + 1) for k, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1])))]
    return sorted(out)


def audited(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r, 1, "x", "y") for i, r in enumerate(rows)], SCHEMA)
    got = source_audit.audit(docs, **options)
    return sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect())


ROWS = [*((prose(i, 5 + i % 60, 90) + " Été ÉTÉ naïve_x a1b", f"l{i % 3}", f"s{i * i % 7}") for i in range(150)),
        (None, None, None), ("", "l0", "empty"), ("lonely words here", "only", "one"), ("same same Same", None, "s1"), ("same", None, "s2"), ("same\0x", None, None),
        ("1 2 3", "digits", "a"), ("4 5", "digits", "b"), *[("hot hot copy", "l1", "s1")] * 90]


@pytest.mark.parametrize("options", [{}, {"top": 5, "min_df": 1}])
def test_against_brute_force(spark, options):
    assert audited(spark, ROWS, **options) == brute(ROWS, **options)


def test_shards_change_nothing(spark):
    assert audited(spark, ROWS, shard_terms=60) == brute(ROWS)


def test_empty_table(spark):
    assert audited(spark, []) == []


def test_very_long_text(spark):
    rows = [(prose(1, 300_000, 5000), "a", "s"), (prose(2, 2000, 5000), "a", "t"), (prose(3, 2000, 5000), "a", "t")]
    assert audited(spark, rows, min_df=2) == brute(rows, min_df=2)
