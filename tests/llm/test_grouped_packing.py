import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from churnlens.llm import byte_tokens, grouped_packing
from churnlens.llm.common import tokenizer_path
from tests.llm.helpers import ODD_ROWS, crc, documents, prose

PATH = tokenizer_path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet="aB'sé É.!|<>12 \n\t  　\u0085\x1c")), max_size=5), st.integers(1, 20))
def test_encoder_equals_the_library(texts, slice_bytes):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    was, byte_tokens.SLICE_BYTES = byte_tokens.SLICE_BYTES, slice_bytes
    try:
        ids, offs = byte_tokens.piece_encoder(PATH, 0).encode(pa.array(texts, pa.string()))
    finally:
        byte_tokens.SLICE_BYTES = was
    assert [list(ids[a:b]) for a, b in zip(offs, offs[1:])] == [ids_of(t) for t in texts]


def check_pieces(rows, expected, capacity=2048):
    """Each document is whole, only its first piece is short, and sequences are gapless and not too long."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    want = {}
    for i, t in expected:
        ids, at, k = ids_of(t), 0, 0
        while at < len(ids):
            n = len(ids) % capacity or capacity if k == 0 else capacity
            want.setdefault(i, []).append((k, at, n, crc(ids[at : at + n])))
            at, k = at + n, k + 1
    assert {i: sorted((p.piece, p.start, p.length, p.ids_crc32) for p in ps) for i, ps in by_doc.items()} == {i: sorted(w) for i, w in want.items()}
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_sequence)


def packed(docs):
    return grouped_packing.pack_documents(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids").collect()


def test_odd_rows(spark):
    check_pieces(packed(documents(spark, ODD_ROWS, extra=("sequence_id", "ids", "piece"))), ODD_ROWS)


def test_many_documents_in_few_sequences(spark):
    rows = [(i, prose(i, 1 + i * 7 % 1900)) for i in range(400)]
    got = packed(documents(spark, rows))
    total = sum(r.length for r in got)
    assert check_pieces(got, rows) <= 1.03 * -(-total // 2048) + 1


def test_hot_copies(spark):
    rows = [(5, prose(1, 500))] * 120 + [(i, "x") for i in range(60)]
    check_pieces(packed(documents(spark, rows)), rows)


def test_empty(spark):
    assert packed(documents(spark, [])) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.sampled_from([1 / 8, 1 / 4, 1 / 3]), st.integers(1, 20))
def test_pack_fits_and_uses_every_sequence(lengths, small, groups):
    n = np.array(lengths, dtype=np.int64)
    where, made = grouped_packing.pack(n, 100, small, groups)
    filled = np.bincount(where, n, made)
    assert (filled <= 100).all() and (filled > 0).all() and len(filled) == made


def least(lengths, capacity):
    """The fewest sequences, by trying every placing."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(5, 100), min_size=1, max_size=9))
def test_pack_is_near_the_least_number(lengths):
    _, made = grouped_packing.pack(np.array(lengths, dtype=np.int64), 100)
    assert made <= least(sorted(lengths, reverse=True), 100) + 1


def test_configurations_reach_the_optimum():
    # 100 of each: pairs 60 + 40 fill a sequence
    chosen = grouped_packing.configurations(np.array([60, 40]), np.array([100, 100]), 100)
    assert sum(times for _, times in chosen) == 100


@pytest.mark.parametrize("low, high, over", [(1, 2048, 1.01), (257, 700, 1.04), (1, 300, 1.001)])
def test_many_lengths(low, high, over):
    n = np.random.default_rng(1).integers(low, high, 12_000)
    _, made = grouped_packing.pack(n)
    assert made <= over * n.sum() / 2048 + 1
