"""The corpus pipeline: five stages over ``documents``, each written and read again.

language ID -> SimHash near-duplicates -> suffix-array dedup -> benchmark decontamination -> packing

Defined results: a stage keeps rows with any null but the text's as they are; null and letterless
texts end at language ID; near-duplicates
and leaks are told by id and text, so rows that share an id or have none stay apart, and rows equal
in both count as one document; a document that
suffix-array dedup leaves without text ends there; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import decontaminate, langid, packing, simhash, suffix_dedup
from churnlens.llm.common import materialised, read_documents, row_key

#: A document is rejected if its foremost language has less than this proportion.
MIN_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; ``lang`` stays as it was given."""
    model = langid.train(docs.where(~(langid.fold("doc_id", 4) == 2)))
    found = langid.predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, "text", ["row"])
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("row.*")


def _identified(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_key): whole rows beside their identity, so that no column can clash."""
    return docs.select(F.struct(*docs.columns).alias("row"), *row_key())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one of the smallest id, and of its texts the one of the least hash."""
    heads = simhash.survivors(docs).select(F.col("doc_id").alias("_head"), F.col("text_key").alias("_key"))
    kept = _identified(docs).join(heads, F.expr("doc_id <=> _head AND text_key = _key"), "left_semi")
    # rows of one identity may differ in other columns: the least one stays
    return kept.groupBy("doc_id", "text_key").agg(F.min("row").alias("row")).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere too; n_chars is counted anew."""
    others = [c for c in docs.columns if c != "text"]
    left = suffix_dedup.remove_repeats(docs.withColumn("_row", F.struct(*others)), ["_row"])
    left = left.where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    own = {"text": F.col("kept_text"),
           "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)}
    return left.select(*[own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = decontaminate.decontaminate(docs, items, keyed=True).where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_key"))
    return _identified(docs).join(bad, F.expr("doc_id <=> _bad AND text_key = _key"), "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    pieces = packing.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("benchmark_leaks", benchmark_leaks), ("packing", packed)]

#: SQL expresses neither the trained model nor the tokenizer; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
