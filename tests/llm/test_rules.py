import random

from churnlens.llm import decontaminate, langid, licenses, quality, toxicity
from tests.llm.helpers import ODD_ROWS, documents, prose


def test_hits_items_and_proximity(spark):
    item = prose(9, 14, 2000)
    words = item.split()
    rows = [*ODD_ROWS, (10, f"x y {item} z"), (11, " ".join(words[:9])), (12, " ".join(words[:5] + ["new"] + words[5:])), (13, "Short. Item!")]
    items = spark.createDataFrame([("b", item), ("a", "short item"), ("c", None), ("d", "")], "item_id string, text string")
    docs = documents(spark, rows, ["k1", "w", "pos"])
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, items).collect()}
    n = len(spark.createDataFrame([(item,)], "t string").select(decontaminate.words_column("t").alias("w")).first()["w"])
    assert (got[10]["n_hit"], got[10]["n_items"], got[13]["n_hit"], got[11]["n_hit"], got[12]["n_hit"]) == (n, 1, 2, 0, 0)
    assert (got[1]["n_words"], got[1]["contaminated"]) == (0, False)
    assert decontaminate.decontaminate(documents(spark, []), items).count() == 0
    windows = decontaminate.item_windows(items)
    terms = decontaminate.vocabulary(windows)
    near = decontaminate.matches(decontaminate.build_index(docs, terms), windows, terms, slop=1)
    assert {r["k1"] for r in near.where("NOT exact").collect()} >= {12}


def test_quality_counts_on_odd_rows(spark):
    rows = [*ODD_ROWS, (20, "a b c a b c\nx\nx\n\n \n#$"), (21, "a a a a")]
    got = {r["doc_id"]: r for r in quality.quality_rules(documents(spark, rows, ["w", "g", "f_lang"])).collect()}
    assert (got[20]["n_words"], got[20]["n_symbols"], got[20]["n_dup_lines"], got[20]["n_repeat_words"]) == (9, 2, 1, 6)
    assert (got[21]["n_repeat_words"], got[1]["n_words"], got[1]["base_failed"], got[1]["kept"]) == (4, 0, True, False)
    assert quality.quality_rules(documents(spark, [])).count() == 0


def test_language_of_mixtures(spark):
    r = random.Random(1)
    words = {"aa": ["lamo", "pelu", "sato", "rima"], "bb": ["xyth", "wrog", "kjel", "vund"]}

    def text(lang, n):
        return " ".join(r.choice(words[lang]) for _ in range(n))

    rows = [(i, text(lang, 30), lang, "s") for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(200, None, "aa", "s"), (201, " 12 ", "bb", "s"), (202, text("aa", 60) + " " + text("bb", 30), None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:80])
    assert (got[200]["lang_pred"], got[201]["lang_pred"], got[202]["lang_pred"], set(got[202]["langs"])) == ("und", "und", "aa", {"aa", "bb"})
    assert langid.identify(df.limit(0)).count() == 0


def test_gapped_insults(spark):
    r = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("ta", "ro", "mi") for b in ("len", "dor", "pa") for c in ("s", "ter", "no")]

    def text(*extra):
        return " ".join([*(r.choice(words) for _ in range(40)), *extra])

    rows = [(i, text("grumblor") if i % 2 else text()) for i in range(300)]
    odd = [(1000, text("g.rumbl.or")), (1001, text()), (1002, ""), (1003, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(documents(spark, rows + odd), labels).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(300))
    assert [got[i]["predicted"] for i in (1000, 1001, 1002)] == [1, 0, 0]
    assert toxicity.toxicity(documents(spark, []), labels).count() == 0


def test_licenses(spark):
    rows = [*ODD_ROWS, *[(100 + i, prose(i, 60)) for i in range(40)], (50, prose(3, 20) + "\nReleased under the MIT License.\n" + prose(4, 20))]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert (got[50]["families"], got[1]["families"], got[1]["n_paragraphs"], got[100]["families"]) == ("mit", "", 0, "")
