"""R7 streaming prediction equals R6 batch prediction on the same rows."""

from pyspark.sql import functions as F

from churnlens.operators import quality as V
from churnlens.plans import registry as reg
from churnlens.plans import training as T
from churnlens.sources.subscriber import subscribers
from churnlens.streaming.predict_stream import read_predictions, read_rejected, start_prediction_stream

from conftest import SF_SMALL


def test_stream_equals_batch(spark, tmp_path):
    df = reg.cleaned(spark, SF_SMALL).persist()
    art = T.train_all(df, search=None, n_init=2, numeric=reg.NUMERIC, categorical=reg.CATEGORICAL)
    raw = subscribers(spark, SF_SMALL)
    src = str(tmp_path / "src")
    raw.repartition(3).write.parquet(src)
    q = start_prediction_stream(spark, src, raw.schema, art, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                                max_files_per_trigger=1)
    q.awaitTermination()
    streamed = read_predictions(spark, str(tmp_path / "out")).drop("epoch")
    batch = T.predict_batch(V.parse_numeric_column(V.valid_rows(V.check_constraints(raw))), art)
    cols = ["customer_id", "prediction", "probability", "risk_level", "explanation"]
    a = sorted(tuple(r) for r in streamed.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b and len(a) > 0
    rejected = read_rejected(spark, str(tmp_path / "out"))
    blank = raw.filter(F.trim("total_charges") == "").count()
    assert rejected.count() == blank
    assert rejected.filter(F.array_contains("violations", "total_charges:numeric")).count() == blank
