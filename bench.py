"""Headline operators at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from colsmith.catalog import QUERIES  # noqa: E402
from colsmith.session import local_session  # noqa: E402

HEADLINE = ["scan_select", "profile_numeric", "profile_category", "column_stats", "winsorize", "drop_near_duplicates", "purge_impurities",
            "kde_compare", "group_aggregates", "pearson_matrix_wide", "spearman", "cramers_v", "correlation_ratio", "nominal_drift",
            "ks_two_sample", "drift_classification", "time_delta_entity", "step_difference", "kmeans_bins", "target_encode",
            "standardize", "split_holdout", "best_threshold", "regression_metrics", "prepare_for_regression", "surrogate_regression",
            "inverse_value_map", "target_encode_wide", "corr_levels_many", "correlated_columns_levels", "impute_iterative_line", "pca_pair",
            "impute_iterative", "adversarial_validation", "boruta_select", "candidate_filter", "candidate_filter_nulls", "group_features_fitted",
            "impute_iterative_two_holes"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": cpus})
    # start the JVM's code paths and the Python workers before the clock
    QUERIES["regression_metrics"](spark, folder).collect()
    seconds: dict[str, float] = {}
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_operators_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
