"""Types of extra CSV columns (S1, V7), the category dictionary (F3) and numeric splits."""

import random

import pytest
from pyspark.sql import functions as F

from churnlens.operators import churn as M
from churnlens.operators import features as Fe
from churnlens.operators import quality as V
from churnlens.plans import registry as reg
from churnlens.sources.readers import column_types, load_customers
from churnlens.sources.schema import REFERENCE_COLUMNS, RENAME

from conftest import SF_SMALL

EXTRAS = {"visits": ["3", " 4", "", "-5"], "spend": ["1.5", "2", "1e3", None], "code": ["007", "x1", "", "12"], "blank": ["", None, " ", ""],
          "big": ["9223372036854775808", "1", "2", "3"]}


def customers_csv(spark, path):
    row = {"tenure": "5", "SeniorCitizen": "0", "MonthlyCharges": "20.5", "TotalCharges": "100", "Churn": "Yes"}
    rows = [tuple([row.get(c, f"v{i}") for c in REFERENCE_COLUMNS] + [v[i] for v in EXTRAS.values()]) for i in range(4)]
    schema = ", ".join(f"`{c}` string" for c in [*REFERENCE_COLUMNS, *EXTRAS])
    spark.createDataFrame(rows, schema).coalesce(1).write.option("header", True).csv(path)


def test_extra_columns_get_their_types(spark, tmp_path):
    customers_csv(spark, str(tmp_path / "csv"))
    df = load_customers(spark, str(tmp_path / "csv"), "csv")
    assert {c: t for c, t in df.dtypes if c in EXTRAS} == {"visits": "bigint", "spend": "double", "code": "string", "blank": "string", "big": "double"}
    numeric, categorical = V.split_columns(df)
    assert {"visits", "spend", "big"} <= set(numeric) and {"code", "blank"} <= set(categorical)
    rows = sorted(df.collect(), key=lambda r: r.customer_id)
    assert [r.visits for r in rows] == [3, 4, None, -5] and [r.spend for r in rows] == [1.5, 2.0, 1000.0, None]
    stated = load_customers(spark, str(tmp_path / "csv"), "csv", {"visits": "string", "spend": "double", "code": "string", "blank": "string", "big": "string"})
    assert dict(stated.dtypes)["visits"] == "string" and dict(stated.dtypes)[RENAME["TotalCharges"]] == "string"


def test_types_of_an_empty_table(spark):
    assert column_types(spark.createDataFrame([], "a string"), ["a"]) == {"a": "string"} and column_types(spark.range(1), []) == {}


def test_dictionary_equals_the_indexer(spark, monkeypatch):
    rows = [("b", "x"), ("a", None), ("b", "é"), (None, "y"), ("Z", "x")] * 5
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, c string, d string")
    enc = Fe.fit_encoding(df, [], ["c", "d"])
    for size in (1, 2, 1_000_000):
        monkeypatch.setattr(Fe, "VALUES_PER_PARTITION", size)
        table = Fe.category_dictionary(df, ["c", "d"])
        assert [f"{r.column}_{r.value}" for r in table.orderBy("slot").collect()] == enc.names
        assert [r.slot for r in table.orderBy("slot").collect()] == list(range(len(enc.names)))
        got = {r.id: r.slots for r in Fe.with_slots(df, table, ["c", "d"]).collect()}
        want = {}
        for r in Fe.active_slots(enc.transform(df), 0, "id").collect():
            want.setdefault(r.id, []).append(r.feature_index)
        assert got == {i: sorted(want.get(i, [])) for i in got}
    unseen = spark.createDataFrame([(1, "new", "x")], "id int, c string, d string")
    assert [len(r.slots) for r in Fe.with_slots(unseen, table, ["c", "d"]).collect()] == [1]


def test_dictionary_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(Fe, "VALUES_PER_PARTITION", 50_000)
    df = spark.range(0, 300_000, 1, 8).selectExpr("id", "concat('Customer#', lpad(pmod(id * 7919, 200000), 9, '0')) AS c", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'cold' END AS d")
    table = Fe.category_dictionary(df, ["d", "c"], 10)
    got = table.agg(F.count("*"), F.min("slot"), F.max("slot"), F.countDistinct("slot")).first()
    assert tuple(got) == (200_002, 10, 200_011, 200_002)
    order = table.where("column = 'c'").selectExpr("cast(substring(value, 10) AS long) - slot AS gap").distinct().collect()
    assert [r.gap for r in order] == [-12]
    assert Fe.with_slots(df, table, ["d", "c"]).where("size(slots) <> 2").count() == 0


def sweep(rows, min_rows):
    """Best (threshold, gain) by trying every midpoint."""
    rows = [r for r in rows if r[0] is not None]
    values = sorted({v for v, _ in rows})
    t1, n = sum(y for _, y in rows), len(rows)
    w = {1: n / (2 * t1) if t1 else 0.0, 0: n / (2 * (n - t1)) if n > t1 else 0.0}

    def gini(part):
        a, b = sum(w[1] for y in part if y), sum(w[0] for y in part if not y)
        return (1 - (a / (a + b)) ** 2 - (b / (a + b)) ** 2 if a + b else 0.0), a + b

    best = None
    whole, total = gini([y for _, y in rows])
    for lo, hi in zip(values, values[1:]):
        left, right = [y for v, y in rows if v <= lo], [y for v, y in rows if v > lo]
        if min(len(left), len(right)) >= min_rows:
            (gl, wl), (gr, wr) = gini(left), gini(right)
            gain = whole - wl / total * gl - wr / total * gr
            if best is None or round(gain, 12) > round(best[1], 12):
                best = ((lo + hi) / 2, gain, len(left), len(right))
    return best


@pytest.mark.parametrize("min_rows", [1, 20])
def test_numeric_splits_equal_a_plain_sweep(spark, min_rows):
    rnd = random.Random(5)
    rows = [(rnd.gauss(0, 1), rnd.randint(0, 6), None if rnd.random() < 0.2 else rnd.random(), 3.0) for _ in range(200)]
    labelled = [(*r, int(r[0] + r[1] / 3 + rnd.gauss(0, 1) > 1)) for r in rows]
    df = spark.createDataFrame(labelled, "a double, b int, c double, d double, churn int").repartition(3)
    got = {r.feature: r for r in M.numeric_splits(df, ["a", "b", "c", "d"], min_rows=min_rows).collect()}
    assert set(got) == {"a", "b", "c"}  # one value alone cannot be split
    for i, c in enumerate("abc"):
        threshold, gain, left, right = sweep([(r[i], r[4]) for r in labelled], min_rows)
        assert (got[c].threshold, got[c].n_left, got[c].n_right) == (threshold, left, right) and abs(got[c].gain - gain) < 1e-9


def test_root_of_the_tree_is_the_best_split(spark):
    df = reg.cleaned(spark, SF_SMALL).persist()
    splits = M.numeric_splits(df, reg.NUMERIC).collect()
    best = max(splits, key=lambda r: r.gain)
    model = M.fit_churn_tree(df, max_depth=1, min_samples_leaf=1, numeric=reg.NUMERIC, categorical=[])
    text = model.tree.toDebugString
    assert f"If (feature {reg.NUMERIC.index(best.feature)} <= {best.threshold}" in text
