"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import (decontaminate, grouped_packing, langid, licenses, packing, quality, resampling, simhash, source_audit, substring_dedup, suffix_dedup,
                           toxicity, wavelet_output)
from churnlens.llm.common import read_documents

QUERIES = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(read_documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")


@register
def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_output.write_and_read_back(read_documents(spark, sf_dir))


@register
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE["op3_decontaminate"] = decontaminate.oracle()


@register
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_documents(spark, sf_dir)).drop("lang", "source")


ORACLE["op8_quality_rules"] = quality.oracle()


@register
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_documents(spark, sf_dir)).withColumn("langs", F.to_json("langs"))


@register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_documents(spark, sf_dir)).drop("kept_text")


@register
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_documents(spark, sf_dir)).drop("kept_text")


@register
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_documents(spark, sf_dir))


@register
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


ORACLE["op11_resampling"] = resampling.oracle()


@register
def op12_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = grouped_packing.pack_documents(read_documents(spark, sf_dir))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@register
def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read_documents(spark, sf_dir))


ORACLE["op13_source_audit"] = source_audit.oracle()
