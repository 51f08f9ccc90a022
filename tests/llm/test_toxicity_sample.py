import random

from pyspark.sql import functions as F

from churnlens.llm import toxicity

WORDS = [f"{a}{b}{c}" for a in ("ta", "ro", "mi") for b in ("len", "dor", "pa") for c in ("s", "ter", "no")]


def test_class_bounds():
    assert toxicity.class_bounds(30, 20, 100) == (30, 20)
    assert toxicity.class_bounds(1000, 1000, 100) == (50, 50)
    assert toxicity.class_bounds(1000, 3, 100) == (97, 3)
    assert toxicity.class_bounds(4, 1000, 101) == (4, 97)
    assert toxicity.class_bounds(9, 9, 1) == (1, 1)


def test_copies_do_not_fill_the_sample(spark):
    r = random.Random(4)
    texts = [(" ".join([*(r.choice(WORDS) for _ in range(30)), *(["grumblor"] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(120)]
    df = spark.createDataFrame(texts, "text string, toxic int")
    # 200 copies of the clean text with the least hash
    least = df.where("toxic = 0").orderBy(F.xxhash64("text")).first()["text"]
    low = df.where(F.xxhash64("text") >= F.xxhash64(F.lit(least))).collect()
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate([(x.text, x.toxic) for x in low] + [(least, 0)] * 200)], "doc_id long, text string, toxic int")
    model = toxicity.train(rows, fit_rows=60)
    assert model["weights"] is not None
    got = toxicity.score(rows.withColumn("held_out", F.lit(False)), model).join(rows, "doc_id")
    assert got.where((F.col("score") >= 0.5) != (F.col("toxic") == 1)).count() == 0


def test_one_class_scores_its_rate(spark):
    rows = spark.createDataFrame([(i, "ta ro grumblor", 1) for i in range(5)], "doc_id long, text string, toxic int")
    model = toxicity.train(rows)
    assert (model["weights"], model["rate"]) == (None, 1.0)
    assert toxicity.train(rows.limit(0))["rate"] == 0.0


def test_word_kernels_do_not_depend_on_what_is_remembered():
    table, norm = toxicity.landmark_table([b"grumblor", b"snarfle"])
    words = [w.encode() for w in WORDS] + [b"grum-blor", b"x" * 100, b"", "é".encode() * 5]
    kernels = toxicity.WordKernels(table, norm)
    kernels.of(words[5:])
    assert (kernels.of(words) == toxicity.kernel(words, table, norm)).all()
    assert b"x" * 100 not in kernels.known and kernels.of([b"grumblor"])[0, 0] > 0.999


def test_least_hashes_keep_the_bound_with_equal_rows(spark):
    rows = spark.createDataFrame([(f"t{h}", h) for h in [5, 1, 1, 3, 3, 3, 3, 9]], "text string, h long")
    for n, want in ((1, [1]), (4, [1, 1, 3, 3]), (8, [1, 1, 3, 3, 3, 3, 5, 9])):
        below, equal = toxicity.least_hashes(rows, n)
        assert sorted(r.h for r in below.unionByName(equal).collect()) == want


def test_contradicting_labels_take_the_greatest(spark):
    rows = [(i, " ".join([WORDS[i % 27], WORDS[(i * 7) % 27], *(["grumblor"] if i % 2 else [])])) for i in range(200)]
    once = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    twice = once.unionByName(once.where("doc_id % 4 = 1").withColumn("toxic", F.lit(0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(tuple(r) for r in toxicity.toxicity(docs, x).collect()) for x in (once, twice)]
    assert [r[3] for r in got[0]] == [r[3] for r in got[1]] == [i % 2 for i in range(200)]
