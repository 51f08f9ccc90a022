"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs its whole plan to a no-op sink (``format("noop")``), so the timing
covers every row without pulling results to the driver.  Model fits (tree, k search)
and the scoring job are timed separately.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

HEADLINE = [
    "Q1_kpi_summary", "Q2_churn_distribution", "Q3_churn_by_contract", "Q4_churn_by_contract_ranked", "Q5_tenure_band",
    "Q6_churn_by_tenure", "Q7_persona_distribution", "Q8_percent_of_rate", "Q9_search_customers", "Q10_filter_contract",
    "Q11_filter_churn", "Q12_filter_risk", "Q13_filter_persona", "Q14_list_customers", "Q15_page_count",
    "C1_cluster_profiles", "E1_confusion_matrix", "E2_binary_metrics", "E3_roc_auc", "E4_roc_curve",
    "E5_classification_report", "V2_drop_unparsable", "V10_dataset_summary", "F7_stratified_split", "D4_root_gini_gain",
    "R5_risk_factors", "K4_silhouette", "K6_assign_cluster",
]


def main() -> None:
    from churnlens.session import get_session

    spark = get_session(f"local[{CPUS}]", app="churnlens-bench", shuffle_partitions=max(CPUS, 8))
    from churnlens.operators import churn as M
    from churnlens.operators import segments as K
    from churnlens.plans import registry as reg
    from churnlens.plans import training as T

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    # warm-up (JVM, codegen caches, file listing) - not timed
    run(reg.QUERIES["V10_dataset_summary"](spark, SF_DIR))

    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        run(reg.QUERIES[name](spark, SF_DIR))
        times[name] = round(time.perf_counter() - t0, 3)

    cleaned = reg.cleaned(spark, SF_DIR).persist()
    cleaned.count()
    t0 = time.perf_counter()
    churn, split = M.train_churn_model(cleaned, numeric=reg.NUMERIC, categorical=reg.CATEGORICAL)
    times["M1_tree_fit"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    seg, search = K.train_segments(cleaned, numeric=reg.NUMERIC, categorical=reg.CATEGORICAL)
    times["K5_k_search_and_fit"] = round(time.perf_counter() - t0, 3)
    from churnlens.operators import personas as P

    profiles = P.cluster_profiles(seg.transform(cleaned))
    art = T.Artifacts(cleaned, churn, split, seg, search, None, profiles)
    from churnlens.operators import dashboard as Q
    from churnlens.session import shared_path
    from churnlens.sources import sinks

    scored_path = shared_path(spark, "bench", spark.sparkContext.applicationId, "scored_customers")
    t0 = time.perf_counter()
    sinks.write_scored(T.score_customers(cleaned, art), scored_path)
    times["R2_score_and_write"] = round(time.perf_counter() - t0, 3)

    # serving path: dashboard queries on the written scored table (filters pushed into the scan)
    serve = {
        "serve_Q1_kpi_summary": lambda t: Q.kpi_summary(t, persona_count=art.k),
        "serve_Q3_churn_by_contract": lambda t: Q.churn_by_contract(t),
        "serve_Q6_churn_by_tenure": lambda t: Q.churn_by_tenure(t),
        "serve_Q14_list_customers": lambda t: Q.list_customers(t, page=3, page_size=20, contract="One year",
                                                               churn="no", risk_level="low", search="customer#0000")[0],
        "serve_Q15_total": lambda t: Q.list_customers(t, page=1, page_size=20, contract="One year", churn="no")[1],
    }
    for name, fn in serve.items():
        t0 = time.perf_counter()
        run(fn(spark.read.parquet(scored_path)))
        times[name] = round(time.perf_counter() - t0, 3)

    total = round(sum(times.values()), 3)
    sf = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()
