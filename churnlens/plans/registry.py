"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver's tables (through the subscriber view or directly) over
whole tables.  The DuckDB twin of each SQL-checkable query lives in ``oracle.py``
under the same key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.columns import label_text
from churnlens.functions.rounding import round_exact
from churnlens.operators import churn as M
from churnlens.operators import dashboard as Q
from churnlens.operators import features as Fe
from churnlens.operators import metrics as E
from churnlens.operators import paging
from churnlens.operators import personas as P
from churnlens.operators import quality as V
from churnlens.operators import scoring as R
from churnlens.operators import search_index
from churnlens.operators import segments as K
from churnlens.plans import training as T
from churnlens.plans.bundle import Bundle
from churnlens.session import shared_path
from churnlens.sources import sinks
from churnlens.sources.readers import read_drivers, read_profiles, read_table
from churnlens.sources.subscriber import subscribers

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn

    return deco


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriber rows after V1 + V2 + V5 + V6.

    The view writes its label as Yes/No text, so V5 is told so (``label_mode="text"``)
    instead of detecting it with a subquery that would re-derive the whole view.
    """
    return V.clean(subscribers(spark, sf_dir), label_mode="text")


# --- scans and cleaning ------------------------------------------------------
@register("S1_subscriber_table")
def s1(spark, sf_dir):
    return subscribers(spark, sf_dir)


@register("V1_parse_numeric")
def v1(spark, sf_dir):
    raw = subscribers(spark, sf_dir).select("cust_key", F.col("total_charges").alias("total_charges_text"), "total_charges")
    return V.parse_numeric_column(raw, "total_charges")


@register("V2_drop_unparsable")
def v2(spark, sf_dir):
    return cleaned(spark, sf_dir)


@register("V2_dropped_count")
def v2_count(spark, sf_dir):
    parsed = V.parse_numeric_column(subscribers(spark, sf_dir))
    return parsed.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.sum(F.col("total_charges").isNull().cast("long")).alias("dropped"),
    )


@register("V5_encode_label")
def v5(spark, sf_dir):
    # the reference's automatic text/number detection, on the parsed and filtered view
    kept = V.parse_numeric_column(subscribers(spark, sf_dir)).filter(F.col("total_charges").isNotNull())
    return V.encode_label(kept, "churn", mode="auto").select("cust_key", "churn")


@register("V9_null_profile")
def v9(spark, sf_dir):
    return V.null_profile(V.parse_numeric_column(subscribers(spark, sf_dir)))


@register("V10_dataset_summary")
def v10(spark, sf_dir):
    return V.dataset_summary(cleaned(spark, sf_dir))


# --- dashboard ---------------------------------------------------------------
@register("Q2_churn_distribution")
def q2(spark, sf_dir):
    return Q.churn_distribution(cleaned(spark, sf_dir))


@register("Q3_churn_by_contract")
def q3(spark, sf_dir):
    return Q.churn_by_contract(cleaned(spark, sf_dir)).drop("_rate").orderBy("contract")


@register("Q4_churn_by_contract_ranked")
def q4(spark, sf_dir):
    return Q.churn_by_contract_ranked(cleaned(spark, sf_dir))


@register("Q5_tenure_band")
def q5(spark, sf_dir):
    return Q.with_tenure_band(cleaned(spark, sf_dir)).select("cust_key", "tenure", "tenure_bin")


@register("Q6_churn_by_tenure")
def q6(spark, sf_dir):
    return Q.churn_by_tenure(cleaned(spark, sf_dir))


# --- shared derived views ----------------------------------------------------

GIVEN_K = 4  # cluster count of the given-label views (cust_key mod 4)
SEARCH_TEXT = "CUSTOMER#0000001.5"  # regex: '.' is any character, case-insensitive


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded (Python semantics) so engine summation order cannot show."""
    dbl = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select([round_exact(F.col(c), digits).alias(c) if c in dbl else F.col(c) for c in df.columns])


def rule_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned rows with a deterministic stand-in score 12 / (12 + tenure) and class score > 0.5."""
    df = cleaned(spark, sf_dir)
    score = F.lit(12.0) / (F.lit(12.0) + F.col("tenure"))
    return df.withColumns({"score": score, "prediction": (score > 0.5).cast("int"), "label": F.col("churn")})


def given_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned rows with given cluster labels (cust_key mod 4) for the persona checks."""
    return cleaned(spark, sf_dir).withColumn("cluster_id", (F.col("cust_key") % GIVEN_K).cast("int"))


def given_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cluster_profiles(given_clusters(spark, sf_dir))


def dashboard_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored customer table built from the rule score and the given clusters."""
    df = given_clusters(spark, sf_dir)
    lookup = P.persona_lookup(P.cluster_profiles(df))
    scored = R.with_risk_level(df.withColumn("churn_probability", F.lit(12.0) / (F.lit(12.0) + F.col("tenure"))))
    scored = R.attach_persona(scored, lookup, known_rows=GIVEN_K)
    return scored.withColumn("churn", label_text("churn")).select(*Q.LISTING_COLUMNS)


# --- personas ----------------------------------------------------------------
@register("C1_cluster_profiles")
def c1(spark, sf_dir):
    return rounded(given_profiles(spark, sf_dir))


@register("C2_characteristics")
def c2(spark, sf_dir):
    return given_profiles(spark, sf_dir).select("cluster_id", "characteristics")


@register("C3_persona_name")
def c3(spark, sf_dir):
    return given_profiles(spark, sf_dir).select("cluster_id", "persona_name")


@register("C5_persona_lookup")
def c5(spark, sf_dir):
    return rounded(P.persona_lookup(given_profiles(spark, sf_dir)))


@register("C6_split_characteristics")
def c6(spark, sf_dir):
    return P.split_characteristics(given_profiles(spark, sf_dir))


@register("C7_persona_display")
def c7(spark, sf_dir):
    return P.persona_display(given_profiles(spark, sf_dir))


# --- evaluation ----------------------------------------------------------------
@register("E1_confusion_matrix")
def e1(spark, sf_dir):
    return E.confusion_matrix(rule_scored(spark, sf_dir))


@register("E2_binary_metrics")
def e2(spark, sf_dir):
    return E.binary_metrics(rule_scored(spark, sf_dir))


@register("E3_roc_auc")
def e3(spark, sf_dir):
    return E.roc_auc(rule_scored(spark, sf_dir))


@register("E4_roc_curve")
def e4(spark, sf_dir):
    return E.roc_curve(rule_scored(spark, sf_dir))


@register("E5_classification_report")
def e5(spark, sf_dir):
    return E.classification_report(rule_scored(spark, sf_dir))


# --- scoring -------------------------------------------------------------------
@register("R1_risk_level")
def r1(spark, sf_dir):
    return dashboard_scored(spark, sf_dir).select("customer_id", "churn_probability", "risk_level")


@register("R3_label_text")
def r3(spark, sf_dir):
    return R.with_label_text(cleaned(spark, sf_dir).select("cust_key", "churn"))


@register("R4_attach_persona")
def r4(spark, sf_dir):
    return dashboard_scored(spark, sf_dir).select("customer_id", "cluster_id", "persona_name")


# --- dashboard over the scored table -------------------------------------------
@register("Q1_kpi_summary")
def q1(spark, sf_dir):
    return rounded(Q.kpi_summary(dashboard_scored(spark, sf_dir), persona_count=GIVEN_K))


@register("Q7_persona_distribution")
def q7(spark, sf_dir):
    return Q.persona_distribution(given_profiles(spark, sf_dir))


@register("Q8_percent_of_rate")
def q8(spark, sf_dir):
    by_contract = Q.churn_by_contract(cleaned(spark, sf_dir))
    return Q.share_of_total(by_contract, "count").select(
        "contract", Q.percent_of_rate("churn_rate").alias("churn_pct"), round_exact(F.col("share"), 6).alias("share"))


@register("Q9_search_customers")
def q9(spark, sf_dir):
    return Q.search_customers(dashboard_scored(spark, sf_dir), SEARCH_TEXT).select("customer_id")


@register("Q10_filter_contract")
def q10(spark, sf_dir):
    return Q.filter_contract(dashboard_scored(spark, sf_dir), "One year").select("customer_id", "contract")


@register("Q11_filter_churn")
def q11(spark, sf_dir):
    return Q.filter_churn(dashboard_scored(spark, sf_dir), " yes ").select("customer_id", "churn")


@register("Q12_filter_risk")
def q12(spark, sf_dir):
    return Q.filter_risk(dashboard_scored(spark, sf_dir), "HIGH ").select("customer_id", "risk_level")


@register("Q13_filter_persona")
def q13(spark, sf_dir):
    return Q.filter_persona(dashboard_scored(spark, sf_dir), "steady|loyal").select("customer_id", "persona_name")


LISTING_FILTERS = dict(contract="Month-to-month", churn="no", search="customer")


@register("Q14_list_customers")
def q14(spark, sf_dir):
    rows, _ = Q.list_customers(dashboard_scored(spark, sf_dir), page=2, page_size=20, **LISTING_FILTERS)
    return rows


@register("Q15_page_count")
def q15(spark, sf_dir):
    _, total = Q.list_customers(dashboard_scored(spark, sf_dir), page=1, page_size=20, **LISTING_FILTERS)
    return total.select("total", Q.page_count("total", 20).alias("page_count"))


# --- features --------------------------------------------------------------------

NUMERIC = ["senior_citizen", "tenure", "monthly_charges", "total_charges"]
CATEGORICAL = ["partner", "dependents", "paperless_billing", "contract", "internet_service", "payment_method"]


def encoded(spark: SparkSession, sf_dir: str):
    df = cleaned(spark, sf_dir)
    enc = Fe.fit_encoding(df, NUMERIC, CATEGORICAL)
    return df, enc


def _names_col(names: list[str]):
    return F.array(*[F.lit(n) for n in names])


@register("F1_impute_median")
def f1(spark, sf_dir):
    parsed = V.parse_numeric_column(subscribers(spark, sf_dir))
    return Fe.impute_median(parsed, ["total_charges"]).select("cust_key", "total_charges")


@register("F2_impute_most_frequent")
def f2(spark, sf_dir):
    return Fe.mode_table(cleaned(spark, sf_dir), CATEGORICAL)


@register("F3_one_hot")
def f3(spark, sf_dir):
    df, enc = encoded(spark, sf_dir)
    slots = Fe.active_slots(enc.transform(df), len(NUMERIC), "cust_key")
    return slots.select("cust_key", F.col("feature_index").cast("int").alias("feature_index"),
                        F.element_at(_names_col(enc.names), F.col("feature_index") + 1).alias("feature"))


@register("F3_category_dictionary")
def f3_dictionary(spark, sf_dir):
    """F3 by the distributed dictionary: the active slots of each row, with the value each one stands for."""
    df = cleaned(spark, sf_dir)
    dictionary = Fe.category_dictionary(df, CATEGORICAL, len(NUMERIC))
    slots = Fe.with_slots(df, dictionary, CATEGORICAL).select("cust_key", F.explode("slots").alias("slot"))
    named = dictionary.select("slot", F.concat_ws("_", "column", "value").alias("feature"))
    return slots.join(named, "slot").select("cust_key", F.col("slot").cast("int").alias("feature_index"), "feature")


@register("F4_feature_names")
def f4(spark, sf_dir):
    _, enc = encoded(spark, sf_dir)
    return spark.range(1).select(F.posexplode(_names_col(enc.names)).alias("feature_index", "feature"))


@register("F6_standardize")
def f6(spark, sf_dir):
    df, enc = encoded(spark, sf_dir)
    return rounded(Fe.slot_statistics(enc.transform(df), enc.names))


@register("F7_stratified_split")
def f7(spark, sf_dir):
    return Fe.stratified_split(cleaned(spark, sf_dir)).select("cust_key", "churn", "is_test")


@register("F8_class_weights")
def f8(spark, sf_dir):
    return Fe.class_weights(cleaned(spark, sf_dir))


@register("M2_model_metadata")
def m2(spark, sf_dir):
    df, enc = encoded(spark, sf_dir)
    split = Fe.stratified_split(df)
    return split.agg(F.sum((~F.col("is_test")).cast("long")).alias("n_train"),
                     F.sum(F.col("is_test").cast("long")).alias("n_test")).select(
        "n_train", "n_test", F.lit(len(enc.names)).alias("n_features"), F.lit(Fe.SEED).alias("random_state"),
        F.lit(Fe.TEST_SIZE).alias("test_size"), F.lit(M.MAX_DEPTH).alias("max_depth"),
        F.lit(M.MIN_SAMPLES_LEAF).alias("min_samples_leaf"))


# --- drivers from the root Gini scan -------------------------------------------------
def gain_table(spark, sf_dir):
    return M.gain_drivers(M.root_gini_gain(cleaned(spark, sf_dir), CATEGORICAL))


@register("D4_root_gini_gain")
def d4(spark, sf_dir):
    return rounded(M.root_gini_gain(cleaned(spark, sf_dir), CATEGORICAL))


@register("D4_numeric_splits")
def d4_numeric(spark, sf_dir):
    return rounded(M.numeric_splits(cleaned(spark, sf_dir), NUMERIC))


@register("D2_top_drivers")
def d2(spark, sf_dir):
    return M.top_drivers(gain_table(spark, sf_dir), 15)


@register("D3_driver_display")
def d3(spark, sf_dir):
    return rounded(M.driver_display(M.top_drivers(gain_table(spark, sf_dir), 10)))


@register("R5_risk_factors")
def r5(spark, sf_dir):
    df, enc = encoded(spark, sf_dir)
    imp = {r["feature"]: r["importance"] for r in gain_table(spark, sf_dir).collect()}  # one row per slot
    imps = [imp.get(n, 0.0) for n in enc.names]
    col = R.risk_factors_of_vector(F.col("features"), enc.names, imps, NUMERIC, 5)
    return R.explode_factors(enc.transform(df).withColumn("risk_factors", col), "cust_key")


# --- embeddings with given labels / centres (K3, K4, K6) -----------------------------


@register("K3_inertia")
def k3(spark, sf_dir):
    return rounded(K.inertia(read_table(spark, sf_dir, "embeddings"), "embedding", "label"), 4)


@register("K4_silhouette")
def k4(spark, sf_dir):
    return rounded(K.silhouette(read_table(spark, sf_dir, "embeddings"), "embedding", "label"), 6)


@register("K6_assign_cluster")
def k6(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    centres = K.centroids(emb, "embedding", "label")
    return K.assign_cluster(emb, "embedding", centres).select("vec_id", "label", "cluster_id")


# --- trained models (rows-only checks) -------------------------------------------------

_TRAINED: dict = {}


def trained(spark: SparkSession, sf_dir: str) -> T.Artifacts:
    """Models trained once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        df = cleaned(spark, sf_dir).persist()
        _TRAINED[key] = T.train_all(df, numeric=NUMERIC, categorical=CATEGORICAL)
    return _TRAINED[key]


def _out(spark, sf_dir, name):
    tag = sf_dir.rstrip("/").rsplit("/", 1)[-1]
    return shared_path(spark, "churnlens-outputs", spark.sparkContext.applicationId, tag, name)


@register("M1_churn_tree_drivers")
def m1(spark, sf_dir):
    return M.feature_importance(spark, trained(spark, sf_dir).churn)


@register("M3_predict_test_rows")
def m3(spark, sf_dir):
    art = trained(spark, sf_dir)
    test = art.split.filter(F.col("is_test")).drop("is_test")
    return art.churn.transform(test).select("cust_key", "churn", "churn_probability", "prediction")


@register("E6_evaluate_model")
def e6(spark, sf_dir):
    return T.metrics_row(trained(spark, sf_dir))


@register("K1_cluster_matrix")
def k1(spark, sf_dir):
    art = trained(spark, sf_dir)
    scaled = art.segments.encoding.transform(art.cleaned)
    return Fe.slot_statistics(scaled, art.segments.names, "scaled")


@register("K2_fit_kmeans")
def k2(spark, sf_dir):
    art = trained(spark, sf_dir)
    return art.segments.transform(art.cleaned).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("count"))


@register("K5_choose_k")
def k5(spark, sf_dir):
    art = trained(spark, sf_dir)
    return art.search.withColumn("chosen", F.col("k") == F.lit(art.chosen_k))


@register("C1_model_profiles")
def c1_model(spark, sf_dir):
    return trained(spark, sf_dir).profiles


@register("R2_score_customers")
def r2(spark, sf_dir):
    art = trained(spark, sf_dir)
    return T.score_customers(art.cleaned, art)


@register("R6_predict_batch")
def r6(spark, sf_dir):
    art = trained(spark, sf_dir)
    return T.predict_batch(subscribers(spark, sf_dir), art)


@register("R7_predict_stream")
def r7(spark, sf_dir):
    from churnlens.streaming.predict_stream import read_predictions, start_prediction_stream

    art = trained(spark, sf_dir)
    run = f"stream-{uuid.uuid4().hex}"  # source, sink and checkpoint of this run only
    src = _out(spark, sf_dir, f"{run}/source")
    raw = subscribers(spark, sf_dir)
    raw.write.parquet(src)
    out = _out(spark, sf_dir, f"{run}/out")
    q = start_prediction_stream(spark, src, raw.schema, art, out, _out(spark, sf_dir, f"{run}/checkpoint"))
    q.awaitTermination()
    return read_predictions(spark, out).drop("epoch")


@register("S3_write_drivers")
def s3(spark, sf_dir):
    path = sinks.write_drivers(gain_table(spark, sf_dir), _out(spark, sf_dir, "drivers"))
    return rounded(read_drivers(spark, path, top_n=15))


@register("S8_read_drivers")
def s8(spark, sf_dir):
    path = sinks.write_drivers(gain_table(spark, sf_dir), _out(spark, sf_dir, "drivers_csv"), fmt="csv")
    return rounded(read_drivers(spark, path, top_n=10, fmt="csv"))


@register("S4_write_profiles")
def s4(spark, sf_dir):
    path = sinks.write_profiles(given_profiles(spark, sf_dir), _out(spark, sf_dir, "profiles"))
    return rounded(read_profiles(spark, path))


@register("S9_read_profiles")
def s9(spark, sf_dir):
    path = sinks.write_profiles(given_profiles(spark, sf_dir), _out(spark, sf_dir, "profiles_csv"), fmt="csv")
    return rounded(read_profiles(spark, path, fmt="csv"))


@register("S5_write_k_search")
def s5(spark, sf_dir):
    art = trained(spark, sf_dir)
    path = sinks.write_k_search(art.search, art.chosen_k, _out(spark, sf_dir, "kmeans_search"), art.k)
    return spark.read.json(path)


@register("S6_write_metrics")
def s6(spark, sf_dir):
    path = sinks.write_metrics(T.evaluation_record(trained(spark, sf_dir)), _out(spark, sf_dir, "metrics"))
    return spark.read.json(path)


@register("S7_save_load_model")
def s7(spark, sf_dir):
    art = trained(spark, sf_dir)
    path = _out(spark, sf_dir, "scoring")
    art.bundle.save(path)
    return Bundle.load(path, spark).score(art.cleaned)


# --- remaining inventory rows: V3, V4, V8, F5, C4 ---------------------------------------
@register("V3_rule_counts")
def v3_counts(spark, sf_dir):
    return V.rule_counts(subscribers(spark, sf_dir))


@register("V3_rejected_rows")
def v3_rejected(spark, sf_dir):
    checked = V.check_constraints(subscribers(spark, sf_dir))
    return V.rejected_rows(checked).select("cust_key", F.explode("violations").alias("rule"))


@register("V4_trim_flags")
def v4(spark, sf_dir):
    return V.trim_flags(subscribers(spark, sf_dir)).select("cust_key", "partner", "dependents", "paperless_billing")


@register("V8_prepare_xy")
def v8(spark, sf_dir):
    return V.prepare_xy(cleaned(spark, sf_dir))


@register("F5_assemble")
def f5(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    df, enc = encoded(spark, sf_dir)
    arr = vector_to_array(F.col("features"))
    return enc.transform(df).select("cust_key", F.posexplode(arr).alias("feature_index", "value")).withColumn(
        "feature_index", F.col("feature_index").cast("int"))


@register("C4_disambiguate_names")
def c4(spark, sf_dir):
    return given_profiles(spark, sf_dir).select(
        "cluster_id", "persona_name", F.col("persona_name").contains(" (C").alias("disambiguated"))


@register("Q14_list_customers_after")
def q14_after(spark, sf_dir):
    """Key-set page for deep paging: the 20 rows after a given id."""
    return Q.list_customers_after(dashboard_scored(spark, sf_dir), "Customer#000000700", 20, **LISTING_FILTERS)


def written_listing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The scored listing written in its order, and a folder for its directory and indexes."""
    base = shared_path(spark, spark.sparkContext.applicationId, f"listing-{uuid.uuid4().hex[:12]}")
    return spark.read.parquet(paging.write_listing(dashboard_scored(spark, sf_dir), f"{base}/rows")), base


@register("Q14_page_directory")
def q14_directory(spark, sf_dir):
    """A deep page through the sparse rank index of the written listing."""
    listing, base = written_listing(spark, sf_dir)
    directory = spark.read.parquet(paging.write_directory(listing, f"{base}/directory", every=100))
    return paging.page_at(listing, directory, page=40, page_size=20)


@register("Q9_search_index")
def q9_index(spark, sf_dir):
    """Ids found through the n-gram index of the written listing."""
    listing, base = written_listing(spark, sf_dir)
    return search_index.search(listing, search_index.write_index(listing, f"{base}/ids"), SEARCH_TEXT).select("customer_id")


@register("Q13_search_index")
def q13_index(spark, sf_dir):
    """Persona names found through the n-gram index of the written listing."""
    listing, base = written_listing(spark, sf_dir)
    index = search_index.write_index(listing, f"{base}/personas", "persona_name")
    return search_index.search(listing, index, "steady|loyal", "persona_name").select("customer_id", "persona_name")


# --- evaluation on labelled documents (quality label, length-based score) ---------------
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels joined to documents: label = quality, score = n_chars / (n_chars + 1000), class score > 0.5."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    score = F.col("n_chars").cast("double") / (F.col("n_chars") + F.lit(1000.0))
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), score.alias("score"), (score > 0.5).cast("int").alias("prediction"))


@register("E1_confusion_matrix_documents")
def e1_docs(spark, sf_dir):
    return E.confusion_matrix(document_scores(spark, sf_dir))


@register("E3_roc_auc_documents")
def e3_docs(spark, sf_dir):
    return E.roc_auc(document_scores(spark, sf_dir))


@register("E4_roc_curve_documents")
def e4_docs(spark, sf_dir):
    return E.roc_curve(document_scores(spark, sf_dir))


@register("E5_classification_report_documents")
def e5_docs(spark, sf_dir):
    return E.classification_report(document_scores(spark, sf_dir))


@register("V6_cast_int")
def v6(spark, sf_dir):
    return V.cast_int(subscribers(spark, sf_dir)).select("cust_key", "senior_citizen")
