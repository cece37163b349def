"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridlens.plans import QUERIES
from gridlens.session import local_session

HEADLINE = (
    "profile_numeric", "profile_missing", "profile_duplicates", "duplicates_many", "describe_numeric",
    "describe_categorical", "correlation_matrix", "detect_task", "topk_per_group", "row_ordinal",
    "histogram", "group_mean", "box_stats", "time_series", "scatter_bins",
    "one_hot_drop_first", "impute_scale", "fill_median", "label_encode", "stratified_split", "kfold_assign",
    "confusion", "class_report", "roc_auc", "roc_auc_ties", "regression_metrics",
    "zero_shot", "summary", "entities", "text_lines", "intent_counts", "chat_context", "nearest_class_top5",
    "anomalies", "trends", "recommendations", "csv_round_trip",
    "train_logistic_regression_classes", "train_random_forest_classes", "train_ridge_regression_numbers",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, app="bench")
    run(spark, "profile_size", folder)  # start the executors
    seconds = {name: round(run(spark, name, folder), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
