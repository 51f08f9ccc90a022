import corpus_pipeline
from churnlens.llm import simhash
from tests.llm.helpers import documents, prose
from tests.llm.test_simhash import fingerprint


def far(seed):
    return prose(seed, 200, 5000)


def test_near_duplicates_keep_texts_that_share_an_id_or_have_none(spark):
    base = far(1).split()
    near = " ".join([*base, "edit"])
    assert fingerprint(near) != fingerprint(far(1)) and (fingerprint(near) ^ fingerprint(far(1))).bit_count() <= simhash.THRESHOLD
    rows = [(None, far(2)), (None, far(3)), (5, far(4)), (5, near), (3, " ".join(base)), (7, far(5)), (7, far(5)), (None, far(5)), (None, far(6)), (None, far(6))]
    docs = documents(spark, rows, extra=("_head", "_key", "text_key", "row"))
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(None, far(2)), (None, far(3)), (None, far(6)), (3, " ".join(base)), (5, far(4)), (7, far(5))]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_leaks_drop_the_leaking_text_alone(spark, tmp_path):
    leak = far(9)
    spark.createDataFrame([("a", leak)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"x {leak}"), (None, far(10)), (None, None), (4, f"y {leak}"), (4, far(11)), (6, far(12))]
    docs = documents(spark, rows, extra=("_bad", "_key", "text_key", "row"))
    got = corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = [(None, far(10)), (None, None), (4, far(11)), (6, far(12))]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
