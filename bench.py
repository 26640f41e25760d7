"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (folder of tables), BENCH_CPUS (local cores) and BENCH_QUERIES
(comma-separated names, default the headline set) can be set.
"""

from __future__ import annotations

import json
import os
import sys
import time

from plumbline.plans.queries import QUERIES
from plumbline.session import local_session

HEADLINE = [
    "profile_nulls", "profile_distinct", "profile_numeric", "profile_quartiles", "outliers_iqr",
    "top_values", "column_profile", "dataset_summary", "duplicate_rows",
    "readiness_score", "readiness_recommendations", "label_encode", "encode_features",
    "target_correlation", "high_correlation_pairs", "mutual_information_binned",
    "mutual_information_knn", "forest_importance", "transform_advice_numeric",
    "model_top3", "report_markdown", "response_extract", "sample_churn", "sample_sales",
    "discover_stages", "discover_orders",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "12g"))
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # noop writes every column of every row and keeps nothing
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
