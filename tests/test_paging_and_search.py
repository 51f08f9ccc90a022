"""Page directory and search index against the plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from churnlens.operators import dashboard as Q
from churnlens.operators import paging, search_index

ROWS = "customer_id string, tenure int, contract string, persona_name string"


def listing(spark, ids):
    r = random.Random(5)
    return spark.createDataFrame([(i, r.randint(0, 9), "One year", r.choice(["Steady Loyal", "New", None])) for i in ids], ROWS)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("ids", [
    [f"C{i:05d}" for i in range(3000)],
    [None] * 40 + [f"C{i % 700:05d}" for i in range(1500)] + ["C00300"] * 900,
    ["same"] * 300,
    [None] * 60,
    [],
])
def test_pages_equal_the_offset_form(spark, tmp_path, ids):
    df = listing(spark, ids)
    paging.write_listing(df, str(tmp_path / "listing"), rows_per_range=400)
    table = spark.read.parquet(str(tmp_path / "listing"))
    paging.write_directory(table, str(tmp_path / "directory"), every=100, keys_per_range=300)
    directory = spark.read.parquet(str(tmp_path / "directory"))
    for page in (1, 2, 7, 15, max(1, -(-len(ids) // 20)), 9999):
        assert rows(paging.page_at(table, directory, page)) == rows(Q.list_customers(df, page)[0])


def test_deep_page_reads_one_key_range(spark, tmp_path):
    df = listing(spark, [f"C{i:05d}" for i in range(4000)])
    paging.write_listing(df, str(tmp_path / "listing"), rows_per_range=500)
    paging.write_directory(df, str(tmp_path / "directory"), every=50)
    table, directory = (spark.read.parquet(str(tmp_path / p)) for p in ("listing", "directory"))
    low, before, high = paging.key_range(directory, 3000, 20)
    assert (low, before, high) == ("C03000", 3000, "C03050")
    plan = paging.page_at(table, directory, 151)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(customer_id,C03000)" in plan and "LessThan(customer_id,C03050)" in plan
    assert directory.count() <= 4000 // 50 + 1
    with pytest.raises(ValueError):
        paging.page_at(table, directory, 0)


PATTERNS = ["c0012", "C00.23", "123|456", "a.b", "12", "^C001", "c(00|01)2", "nothing here", "K0", "ski", "", "cust", "C0|zzz"]


@pytest.mark.parametrize("literal", [False, True])
def test_index_gives_the_rows_of_the_scan(spark, tmp_path, literal):
    ids = [f"C{i:05d}" for i in range(2500)] + ["c00123", "C00123", "a.b", "axb", None, "", "x", "ſKı", "İSKI", "cust-1", "Straße123"]
    df = listing(spark, ids)
    path = search_index.write_index(df, str(tmp_path / "index"), rows_per_range=5000)
    for p in PATTERNS:
        assert sorted(rows(search_index.search(df, path, p, literal=literal)), key=str) == sorted(rows(Q.search_customers(df, p, literal)), key=str), p
    people = search_index.write_index(df, str(tmp_path / "people"), "persona_name")
    assert sorted(rows(search_index.search(df, people, "steady|loyal", "persona_name")), key=str) == sorted(rows(Q.filter_persona(df, "steady|loyal")), key=str)


def test_index_joins_many_values_and_pushes_few(spark, tmp_path, monkeypatch):
    df = listing(spark, [f"C{i:05d}" for i in range(2500)])
    df.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    path = search_index.write_index(table, str(tmp_path / "index"))
    found = search_index.search(table, path, "c0012")
    assert "In(customer_id" in found._jdf.queryExecution().executedPlan().toString().replace("PushedFilters: [In(", "In(") and found.count() == 10
    monkeypatch.setattr(search_index, "PUSHED", 3)
    assert search_index.search(table, path, "c0012").count() == 10
    assert search_index.search(table.limit(0), path, "c0012").count() == 0


def test_required_grams():
    assert search_index.required_grams("Abcd.xy|123") == [["abc", "bcd"], ["123"]]
    assert search_index.required_grams("abc|x") is None
    assert search_index.required_grams("a+bcd") is None
    assert search_index.required_grams("a+bc", literal=True) == [["+bc", "a+b"]]
