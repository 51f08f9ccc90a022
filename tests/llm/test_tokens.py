import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from churnlens.llm import packing, wavelet_output
from churnlens.llm.common import scratch, tokenizer_path
from churnlens.llm.tokens import encoder
from tests.llm.helpers import ODD_ROWS, crc, documents, prose

WHOLE = Tokenizer.from_file(tokenizer_path())


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet="aB'sé É.!|<> \n\t́012"))))
def test_encoder_equals_the_library(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    ids, offs = encoder(tokenizer_path()).encode(pa.array(texts, pa.string()))
    assert [list(ids[a:b]) for a, b in zip(offs, offs[1:])] == [ids_of(t) for t in texts]


def check_pieces(rows, expected):
    """Each id in one piece, sequences gapless and at powers of two or 2048."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(map(str, by_doc)) == sorted({str(i) for i, _ in expected})
    for i, t in expected:
        want = ids_of(t)
        copies = sum(x == (i, t) for x in expected)
        for p in by_doc[i]:
            assert p.doc_tokens == len(want) and p.ids_crc32 == crc(want[p.start : p.start + p.length])
        covered = sorted((p.start, p.length) for p in by_doc[i])
        assert sum(n for _, n in covered) == copies * len(want)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0


def packed(docs):
    from pyspark.sql import functions as F

    return packing.pack_documents(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids").collect()


def test_packing_odd_rows(spark):
    check_pieces(packed(documents(spark, ODD_ROWS, extra=("sequence_id", "ids"))), ODD_ROWS)


def test_packing_many(spark):
    rows = [(i, prose(i, 1 + i * 7 % 900)) for i in range(300)]
    got = packed(documents(spark, rows))
    check_pieces(got, rows)
    whole = {(r.doc_id, r.start) for r in got}
    assert len(whole) == len(got)


def test_packing_empty(spark):
    assert packed(documents(spark, [])) == []


@given(st.lists(st.integers(1, 9000), max_size=60))
@settings(max_examples=60, deadline=None)
def test_pack_lengths_covers_every_token_once(lengths):
    out = packing.pack_lengths(lengths)
    seen = sorted((d, s, n) for _, w in out for d, s, n in w)
    for d, n in enumerate(lengths):
        at = 0
        for _, s, k in [x for x in seen if x[0] == d]:
            assert s == at
            at += k
        assert at == n
    assert all(t & (t - 1) == 0 and sum(n for _, _, n in w) == t for t, w in out)


def test_step_groups_balance_cost():
    sequences = packing.pack_lengths([100 + 37 * i % 1900 for i in range(3000)])
    steps = packing.step_groups(sequences)
    cost = {}
    for (tier, w), s in zip(sequences, steps):
        if tier == 2048:
            cost.setdefault(s, []).append(sum(n * n for _, _, n in w))
    sums = [sum(c) for c in cost.values()]
    assert len(sums) > 10 and max(sums) < 1.25 * min(sums)


@pytest.mark.parametrize("length", [0, 1, 4095, 4096, 4097, 20_000])
def test_wavelet_matrix(length):
    ids = np.random.default_rng(length).integers(0, 50, length).astype(np.uint16) * 999
    m = wavelet_output.WaveletMatrix.build(ids)
    assert (m.decode() == ids).all()
    for t in (0, 999, 48951, 7):
        where = np.flatnonzero(ids == t)
        assert m.rank(t, length) == len(where) and m.rank(t, length // 2) == (where < length // 2).sum()
        for k in {0, len(where) // 2, len(where) - 1} & set(range(len(where))):
            assert m.select(t, k) == where[k]
        assert m.select(t, len(where)) == -1
    for at in range(0, length, 997):
        assert m.access(at) == ids[at]


def test_wavelet_planes_are_built_and_read_by_places():
    """Random bits are parted and joined in less time than by masks; planes over several chunks equal those of plain masks."""
    import time

    def spent(f):
        took = []
        for _ in range(5):
            begun = time.process_time()
            f()
            took.append(time.process_time() - begun)
        return min(took)

    ids = np.random.default_rng(1).integers(0, 1 << 16, 1 << 21).astype(np.uint16)
    bit, low = ids & 1 == 1, ids & np.uint16(0xFFFE)
    parted, zeros = wavelet_output._parted(ids, bit)
    assert (wavelet_output._joined(parted & np.uint16(0xFFFE), bit, zeros, np.uint16(1)) == ids).all()

    def masks():
        out = np.empty_like(ids)
        out[~bit], out[bit] = low[:zeros], low[zeros:]

    assert spent(lambda: wavelet_output._parted(ids, bit)) < 0.8 * spent(lambda: np.concatenate([ids[~bit], ids[bit]]))
    assert spent(lambda: wavelet_output._joined(low, bit, zeros, np.uint16(1))) < 0.8 * spent(masks)
    ids = np.random.default_rng(2).integers(0, 1 << 16, 100_001).astype(np.uint16)
    m, now = wavelet_output.WaveletMatrix.build(ids), ids
    for b, plane, zeros, ranks in zip(reversed(range(16)), m.planes, m.zeros, m.ranks):
        bit = now >> b & 1 == 1
        assert plane == np.packbits(bit).tobytes() and zeros == (~bit).sum()
        assert np.frombuffer(ranks, "<u4").tolist() == [int(bit[:at].sum()) for at in range(0, len(bit), 4096)]
        now = np.concatenate([now[~bit], now[bit]])


def test_token_output_round_trip(spark):
    rows = [*ODD_ROWS, *((100 + i, prose(i, i % 50)) for i in range(200))]
    got = wavelet_output.write_and_read_back(documents(spark, rows, extra=("part",))).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for i, t in order:
        ids = ids_of(t)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want


def test_token_index_queries(spark):
    out = scratch(spark, "t")
    rows = [(i, prose(i, 400)) for i in range(50)]
    wavelet_output.write_tokens(documents(spark, rows), out)
    every = [x for _, t in rows for x in ids_of(t)]
    token = max(set(every), key=every.count)
    assert [tuple(r) for r in wavelet_output.token_counts(spark, out, [token, 1]).orderBy("token").collect()] == sorted([(token, every.count(token)), (1, every.count(1))])
    assert wavelet_output.occurrences(spark, out, token).count() == every.count(token)


def test_token_output_empty(spark):
    assert wavelet_output.write_and_read_back(documents(spark, [])).collect() == []
