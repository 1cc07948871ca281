"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_ONLY    comma-separated query names (default: the headline list)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evenkeel.catalog import QUERIES  # noqa: E402
from evenkeel.session import local_session  # noqa: E402

HEADLINE = [
    "balanced_class_profile", "random_oversampling", "weighted_sample", "stratified_folds",
    "nested_folds", "order_feature_recipe", "pooled_levels", "central_moments",
    "covariance_matrix", "column_description", "value_histogram", "roc_auc",
    "roc_auc_by_group_with_ties", "top_lift", "ks_two_sample", "wasserstein_distance",
    "nearest_within_class", "nearest_any_class", "smote", "smote_mixed", "adasyn",
    "tomek_cleaning", "generator_resample", "independent_marginals", "updated_generator_state",
    "fidelity_report", "upsampling_test", "nested_cross_validation",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, partitions=max(cpus, 1))
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
