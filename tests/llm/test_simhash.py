import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from churnlens.llm import simhash
from churnlens.llm.components import connected_components
from tests.llm.helpers import ODD_ROWS, documents, prose


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, fps[i], least.get(root(i))) for i, (d, _) in enumerate(rows)]


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def test_text_fingerprints():
    texts = [t for _, t in ODD_ROWS] + ["a b", "A  B\nc D e É", " x y z w ", "x", ""]
    got = simhash.text_fingerprints(pa.array(texts, pa.string()))
    assert [int(x) for x in got] == [fingerprint(t) for t in texts]
    assert len(simhash.text_fingerprints(pa.array([], pa.string()))) == 0


def test_anchors_meet_for_every_pair_in_reach():
    r = np.random.default_rng(5)
    for first, bits in simhash.BLOCKS:
        x = r.integers(0, 1 << bits, 400)
        y = x ^ (1 << r.integers(0, bits, 400))
        home, _, _ = simhash.anchors(x, bits, 2)
        _, rows, found = simhash.anchors(y, bits, 2)
        reached = set(zip(rows.tolist(), found.tolist()))
        assert all((i, h) in reached for i, h in enumerate(home.tolist()))


def test_near_duplicates_against_brute_force(spark):
    rows = list(ODD_ROWS)
    for i in range(60):
        base = prose(i, 60 + i, 2000).split()
        rows.append((100 + 10 * i, " ".join(base)))
        for k in range(i % 5):
            copy = list(base)
            copy[(k * 13) % len(copy)] = f"edit{k}"
            rows.append((101 + 10 * i + k, " ".join(copy)))
    rows += [(3000 + i, f"w{i % 3} w{i % 2}") for i in range(40)]
    got = simhash.near_duplicates(documents(spark, rows, extra=("fp", "least"))).collect()
    want = components(rows)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert len({w[2] for w in want}) < len(rows) - 60


def test_links_of_planted_bit_flips(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(300)]
    rows, joined = [], []
    for b in base:
        near = b
        for bit in r.sample(range(64), 4):
            near ^= 1 << bit
        rows += [b, near]
        joined.append(frozenset((b, near)))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in rows]
    got = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    assert {frozenset((a.u % (1 << 64), a.v % (1 << 64))) for a in got} == set(joined)


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[1000 + i] == 1000 for i in range(200))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
