"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the table folder, BENCH_CPUS the number of local cores. A query is timed from building its
DataFrame to the last row, written to Spark's noop sink. BENCH_QUERIES (comma separated) picks others.
"""

from __future__ import annotations

import json
import os
import time

from prospecta.session import build_session
from prospecta.workload import all_queries

HEADLINE = [
    "batch_kpis", "campaign_kpis", "rate_by_job", "batch_status", "batch_results", "customer_overview",
    "results_by_priority", "customer_rule_failures", "upserted_customers", "batch_flow_predictions",
    "log_totals", "log_metrics_by_service", "retained_logs", "streamed_logs",
    "cleaned_training_rows", "stratified_split", "stratified_folds", "metrics_at_threshold", "best_threshold",
    "roc_auc", "roc_auc_unrounded_scores", "scored_test_rows", "synthetic_rows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        f"local[{cores}]", "bench", spark__sql__shuffle__partitions=cores, spark__ui__enabled="false",
        spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{folder}/nation.parquet").count()  # start the session
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
