"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (no collect), after one
warm-up query; with BENCH_REPEAT > 1 the median is reported.  Prints one JSON
line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "C01_drift_statistics", "C02_ks_statistic", "C06_chi2_statistic", "B13_integrity_columns", "B14_histogram",
    "D04_column_stats", "D04_grouped_quantiles", "F02_pair_rules", "G02_stratified_split",
    "G03_chronological_split", "G09_time_series_split", "H04_robust_scale", "I07_tfidf", "J04_ts_features",
    "J06_running_best", "M01_classification_metrics", "M05_roc_auc", "M14_ndcg", "M16_cluster_separation",
    "E07_knn_join", "L37_local_outlier_factor", "K03_telemetry_windows", "K04_windowed_drift", "O11_leaderboard",
    "F05_fpgrowth_itemsets", "L02_random_forest", "L32_dbscan", "O04_model_selection",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from tessera.plans.registry import queries
    from tessera.session import get_spark
    spark = get_spark(f"local[{cpus}]", app="tessera-bench", shuffle_partitions=int(cpus) * 2)
    qs = queries()
    names = only or [q for q in HEADLINE if q in qs]
    # warm-up: JVM, parquet footers, codegen caches
    qs["B08_distinct_values"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, errors = {}, {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.time()
            try:
                qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            except Exception as e:  # report, keep going
                errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
                break
            runs.append(time.time() - t0)
        if runs:
            times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": int(cpus), "repeat": repeat,
           "shuffle_partitions": int(cpus) * 2, "pyspark": spark.version}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
