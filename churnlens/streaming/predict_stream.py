"""Batch prediction over a stream of subscriber records.

``readStream`` -> V4 + V3 checks -> valid rows go through R6 to one sink, rejected rows (with the
broken rule ids) to a second sink.  The operator is stateless and the model side (one loaded
scoring pipeline) is static, so there is no watermark and no state store.

An epoch's rows are written to folders of that attempt alone, and then published by one commit
file that is put in place by an atomic rename.  Readers resolve the commit files first, so they
see an epoch's two outputs as one attempt wrote them, or not at all; a replayed epoch replaces
the commit file and leaves the older attempt's folders unnamed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from churnlens.operators import quality as V
from churnlens.plans.bundle import Bundle, check_records
from churnlens.plans.training import Artifacts, bundle_of


def predict_microbatch(checked: DataFrame, art: Artifacts | Bundle) -> tuple[DataFrame, DataFrame]:
    """(predictions, rejected rows) for one checked batch of raw records."""
    return bundle_of(art).predict_valid(V.valid_rows(checked)), V.rejected_rows(checked)


def write_epoch(batch: DataFrame, epoch: int, art: Artifacts | Bundle, out_dir: str) -> str:
    """Writes one attempt of an epoch to both sinks, without publishing it; returns the attempt's name."""
    out, attempt = out_dir.rstrip("/"), uuid.uuid4().hex
    checked = check_records(batch).persist()  # read once, written to two sinks
    try:
        preds, bad = predict_microbatch(checked, art)
        preds.write.parquet(f"{out}/predictions/epoch={epoch}/attempt={attempt}")
        bad.write.parquet(f"{out}/rejected/epoch={epoch}/attempt={attempt}")
    finally:
        checked.unpersist()
    return attempt


def commit_epoch(spark: SparkSession, out_dir: str, epoch: int, attempt: str) -> None:
    """Publishes an attempt: its commit file appears, or replaces the older one, in one rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    folder = f"{out_dir.rstrip('/')}/commits"
    hidden, named = fs.Path(f"{folder}/.{epoch}-{attempt}"), fs.Path(f"{folder}/{epoch}.json")
    stream = hidden.getFileSystem(conf).create(hidden, True)
    try:
        stream.write(bytearray(json.dumps({"epoch": epoch, "attempt": attempt}).encode()))
    finally:
        stream.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(named.getFileSystem(conf).getUri(), conf).rename(hidden, named, how)


def start_prediction_stream(spark: SparkSession, source: str, schema: StructType, art: Artifacts | Bundle, out_dir: str,
                            checkpoint: str, fmt: str = "parquet", available_now: bool = True,
                            max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source)

    def sink(batch: DataFrame, epoch: int) -> None:
        commit_epoch(batch.sparkSession, out_dir, epoch, write_epoch(batch, epoch, art, out_dir))

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def committed(spark: SparkSession, out_dir: str) -> list[tuple[int, str]]:
    """(epoch, attempt) of every published epoch: one short row each."""
    rows = spark.read.schema("epoch long, attempt string").json(f"{out_dir.rstrip('/')}/commits").collect()
    return sorted((r["epoch"], r["attempt"]) for r in rows)


def _read(spark: SparkSession, out_dir: str, sink: str) -> DataFrame:
    base = f"{out_dir.rstrip('/')}/{sink}"
    paths = [f"{base}/epoch={e}/attempt={a}" for e, a in committed(spark, out_dir)]
    if not paths:
        raise ValueError(f"no epoch has been published under {out_dir}")
    return spark.read.option("basePath", base).parquet(*paths).drop("attempt")


def read_predictions(spark: SparkSession, out_dir: str) -> DataFrame:
    return _read(spark, out_dir, "predictions")


def read_rejected(spark: SparkSession, out_dir: str) -> DataFrame:
    return _read(spark, out_dir, "rejected").withColumn("n_violations", F.size("violations"))
