import hashlib
import random
import re

import numpy as np
import pytest

from churnlens.llm import substring_dedup, suffix_dedup
from tests.llm.helpers import documents, prose


def order(row):
    return (row[0] is not None, row[0] or 0)


def by_words(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=order):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for at in range(len(words) - 19):
            w = tuple(words[at : at + 20])
            if w in seen:
                gone.update(range(at, at + 20))
            seen.add(w)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def by_bytes(rows):
    count, out = {}, []
    for _, text in rows:
        raw = (text or "").encode()
        for at in range(len(raw) - 199):
            count[raw[at : at + 200]] = count.get(raw[at : at + 200], 0) + 1
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 199):
            if count[raw[at : at + 200]] > 1:
                gone[at : at + 200] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def rows(seed):
    r = random.Random(seed)
    passage, other = prose(seed, 60), prose(seed + 1, 45)
    out = [(None, prose(2, 30) + " " + passage), (1, None), (2, ""), (3, " \n\t "), (4, passage), (5, "é" * 700), (6, "a b " * 300), (7, "x")]
    for i in range(10, 60):
        text = prose(seed * 1000 + i, r.randrange(5, 200))
        for p in (passage, other):
            if r.random() < 0.4:
                at = r.randrange(len(text))
                text = text[:at] + " " + p + "\n" + text[at:]
        out.append((i, text))
    out += [(100 + i, out[20][1]) for i in range(30)] + [(200, prose(5, 3000)), (201, prose(5, 3000)[7:-9]), (202, prose(6, 40) * 8)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force(spark, seed):
    data = rows(seed)
    docs = documents(spark, data, ["k1", "runs", "kept", "packed"]).repartition(5)
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=order) == by_words(data)
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=order) == sorted(by_bytes(data), key=order)


def test_repeated_rows_are_one_document_and_empty_table(spark):
    data = [(1, prose(1, 80)), (1, prose(1, 80))]
    for module in (substring_dedup, suffix_dedup):
        found = module.remove_repeats(documents(spark, data)).collect()
        assert [r["n_removed"] for r in found] == [0, 0]
        assert module.remove_repeats(documents(spark, [])).count() == 0


def test_bounded_prefixes():
    r = random.Random(3)
    for _ in range(60):
        s = [bytes(r.choice(b"ab") for _ in range(r.randrange(4, 60))) for _ in range(r.randrange(1, 6))]
        found = suffix_dedup.repeated_places(s, 4)
        whole = [x[i : i + 4] for x in s for i in range(len(x) - 3)]
        assert [f.tolist() for f in found] == [[whole.count(x[i : i + 4]) > 1 for i in range(len(x) - 3)] for x in s]
