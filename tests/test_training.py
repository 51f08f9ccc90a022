"""End-to-end job: train, write every output, read them back."""

from pyspark.sql import functions as F

from churnlens.operators import churn as M
from churnlens.plans import registry as reg
from churnlens.plans import training as T
from churnlens.sources.readers import read_drivers, read_profiles

from conftest import SF_CHECK


def test_write_outputs_round_trip(spark, tmp_path):
    df = reg.cleaned(spark, SF_CHECK).persist()
    art = T.train_all(df, search=(2, 3), n_init=2, numeric=reg.NUMERIC, categorical=reg.CATEGORICAL)
    assert art.k == 4 and art.chosen_k in (2, 3)
    out = str(tmp_path / "run")
    paths = T.write_outputs(spark, art, out)
    drivers = read_drivers(spark, paths["drivers"], top_n=50).collect()
    assert len(drivers) == len(art.churn.names) and drivers[0]["rank"] == 1
    profiles = read_profiles(spark, paths["profiles"]).collect()
    assert [p.cluster_id for p in profiles] == [0, 1, 2, 3]
    assert sum(p["count"] for p in profiles) == df.count()
    metrics = spark.read.json(paths["metrics"]).first()
    assert 0.0 <= metrics["accuracy"] <= 1.0 and 0.0 <= metrics["roc_auc"] <= 1.0
    search = spark.read.json(paths["k_search"]).orderBy("k").collect()
    assert [r.k for r in search] == [2, 3] and sum(r.chosen for r in search) == 1
    scored = spark.read.parquet(paths["scored"])
    assert scored.count() == df.count()
    assert scored.filter(F.col("persona_name").isNull() | F.col("risk_level").isNull()).count() == 0
    loaded = M.ChurnModel.load(f"{out}/models/churn")
    a = {r.cust_key: r.churn_probability for r in loaded.transform(df).select("cust_key", "churn_probability").collect()}
    b = {r.cust_key: r.churn_probability for r in art.churn.transform(df).select("cust_key", "churn_probability").collect()}
    assert a == b
