"""The saved scoring pipeline (S7): a second application scores tables and streams as the first one did."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from churnlens.operators import quality as V
from churnlens.plans import registry as reg
from churnlens.plans import training as T
from churnlens.plans.bundle import Bundle
from churnlens.sources.subscriber import subscribers

from conftest import SF_SMALL

SECOND = """
import sys
from churnlens.session import get_session
from churnlens.plans.bundle import Bundle
from churnlens.streaming.predict_stream import read_predictions, read_rejected, start_prediction_stream
home = sys.argv[1]
spark = get_session("local[2]", app="second", shuffle_partitions=2)
bundle = Bundle.load(f"{home}/scoring", spark)
bundle.score(spark.read.parquet(f"{home}/cleaned")).write.parquet(f"{home}/scored-again")
valid, bad = bundle.predict(spark.read.parquet(f"{home}/raw"))
valid.write.parquet(f"{home}/predicted-again")
schema = spark.read.parquet(f"{home}/raw").schema
start_prediction_stream(spark, f"{home}/raw", schema, bundle, f"{home}/stream", f"{home}/ckpt", max_files_per_trigger=1).awaitTermination()
read_predictions(spark, f"{home}/stream").write.parquet(f"{home}/streamed-again")
read_rejected(spark, f"{home}/stream").write.parquet(f"{home}/rejected-again")
"""


@pytest.fixture(scope="module")
def trained(spark):
    df = reg.cleaned(spark, SF_SMALL).persist()
    return T.train_all(df, search=None, n_init=2, numeric=reg.NUMERIC, categorical=reg.CATEGORICAL)


def by_key(df, columns):
    rows = sorted((r.customer_id, tuple(r[c] for c in columns)) for r in df.collect())
    assert rows
    return rows


def test_second_application_equals_the_first(spark, trained, tmp_path):
    home = str(tmp_path)
    raw = subscribers(spark, SF_SMALL)
    trained.bundle.save(f"{home}/scoring")
    trained.cleaned.write.parquet(f"{home}/cleaned")
    raw.repartition(3).write.parquet(f"{home}/raw")
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", SECOND, home], env={**os.environ, "PYTHONPATH": here}, cwd=home, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    scored = T.score_customers(trained.cleaned, trained)
    assert by_key(scored, scored.columns) == by_key(spark.read.parquet(f"{home}/scored-again"), scored.columns)
    valid, bad = trained.bundle.predict(raw)
    columns = valid.columns
    first = by_key(valid, columns)
    assert first == by_key(spark.read.parquet(f"{home}/predicted-again"), columns)
    assert first == by_key(spark.read.parquet(f"{home}/streamed-again"), columns)
    assert by_key(bad, ["violations"]) == by_key(spark.read.parquet(f"{home}/rejected-again"), ["violations"])
    assert len(first) + bad.count() == raw.count()


def test_scoring_keeps_the_rows_own_values(spark, trained):
    """Imputation goes to working columns: what was missing stays missing in the scored table."""
    row = trained.cleaned.limit(4)
    holes = row.withColumns({"tenure": F.lit(None).cast("int"), "contract": F.lit(None).cast("string")})
    out = T.score_customers(holes, trained).collect()
    assert len(out) == 4 and all(r.tenure is None and r.contract is None and r.churn_probability is not None and r.persona_name for r in out)
    plain = {r.customer_id: r for r in trained.churn.transform(holes).collect()}
    assert all(r.tenure is None for r in plain.values())
    filled = row.withColumns({c: F.lit(trained.churn.fill[c]) for c in ("tenure", "contract")})
    want = {r.customer_id: r.churn_probability for r in trained.churn.transform(filled).collect()}
    assert {r.customer_id: r.churn_probability for r in out} == want


def test_prediction_trims_and_checks(spark, trained):
    rows = subscribers(spark, SF_SMALL).where(F.trim("total_charges") != "").limit(5)
    padded = rows.withColumn("partner", F.concat(F.lit("  "), "partner", F.lit(" ")))
    assert by_key(T.predict_batch(padded, trained), ["probability"]) == by_key(T.predict_batch(rows, trained), ["probability"])
    bad = rows.withColumns({"tenure": F.lit(-1), "contract": F.lit("Weekly")})
    valid, rejected = trained.bundle.predict(bad)
    assert valid.count() == 0
    assert all({"tenure:min", "contract:domain"} <= set(r.violations) for r in rejected.collect())
    unlabelled = rows.drop("churn")
    assert T.predict_batch(unlabelled, trained).count() == 5


def test_narrow_plan_without_python(spark, trained):
    plan = T.score_customers(trained.cleaned, trained)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "hashpartitioning" not in plan.split("InMemoryTableScan")[0]


def test_missing_bundle_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no readable scoring pipeline at"):
        Bundle.load(str(tmp_path / "nowhere"), spark)


def test_segments_reload_alone(spark, trained, tmp_path):
    from churnlens.operators.segments import ClusterModel

    trained.segments.save(str(tmp_path / "seg"))
    loaded = ClusterModel.load(str(tmp_path / "seg"))
    assert loaded.names == trained.segments.names
    assert by_key(loaded.transform(trained.cleaned), ["cluster_id"]) == by_key(trained.segments.transform(trained.cleaned), ["cluster_id"])


def test_evaluation_record_is_whole(spark, trained, tmp_path):
    from churnlens.sources import sinks

    row = spark.read.json(sinks.write_metrics(T.evaluation_record(trained), str(tmp_path / "metrics"))).first()
    m = row["confusion_matrix"]
    n = m["tn"] + m["fp"] + m["fn"] + m["tp"]
    assert n == row["n_test"] and row["n_train"] + n == trained.cleaned.count()
    assert abs(row["accuracy"] - (m["tn"] + m["tp"]) / n) < 1e-12
    assert [r["label"] for r in row["report"]] == ["No Churn", "Churn", "accuracy", "macro avg", "weighted avg"]
    assert [d["rank"] for d in row["top_drivers"]] == list(range(1, 11))


def test_committed_epochs_alone_are_read(spark, trained, tmp_path):
    from churnlens.streaming import predict_stream as S

    out = str(tmp_path / "out")
    raw = V.valid_rows(V.check_constraints(subscribers(spark, SF_SMALL)))
    first, second = raw.limit(10), raw.limit(7)
    S.commit_epoch(spark, out, 0, S.write_epoch(first, 0, trained, out))
    assert S.read_predictions(spark, out).count() == 10
    replay = S.write_epoch(second, 0, trained, out)  # written, not yet published: readers see the old epoch
    assert S.read_predictions(spark, out).count() == 10
    reader = S.read_predictions(spark, out)
    S.commit_epoch(spark, out, 0, replay)
    assert reader.count() == 10  # a reader that had begun keeps the epoch it resolved
    assert S.read_predictions(spark, out).count() == 7 and len(S.committed(spark, out)) == 1
    assert S.read_predictions(spark, out).columns == [*first.select("customer_id").columns, *S.read_predictions(spark, out).columns[1:]]


def test_no_published_epoch(spark, tmp_path):
    from churnlens.streaming import predict_stream as S

    (tmp_path / "out" / "commits").mkdir(parents=True)
    with pytest.raises(ValueError, match="no epoch has been published"):
        S.read_predictions(spark, str(tmp_path / "out"))
