"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES
from ebbtide.session import local_session

HEADLINE = (
    "engineered_features",
    "encoded_customers",
    "churn_by_tenure_group_and_contract",
    "overview",
    "charges_histogram",
    "record_violations",
    "data_gate_table",
    "exact_medians",
    "train_test_split",
    "cross_validation_folds",
    "churner_neighbours",
    "synthetic_churners",
    "scored_customers",
    "contribution_reasons_text",
    "monitoring_log",
    "stream_scoring_log",
    "ranking_metrics",
    "run_comparison",
    "forest_importances",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    QUERIES["overview"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
