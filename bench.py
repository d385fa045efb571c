"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON: the median of three warm runs of each."""

from __future__ import annotations

import json
import os
import statistics
import time

from accordant import queries
from accordant.session import get_session

HEADLINE = (
    "validate_lineitem", "validate_enforce", "check_uuid", "check_datetime", "check_drift", "sql_test_between", "sql_test_unique", "profile_numeric", "profile_strings", "infer_contract_clauses", "baseline_stats",
    "flatten_orders_explode", "trace_risk", "prompt_family_rate", "blast_radius_fallback", "schema_impact", "lineage_bfs_down", "token_histogram", "hashed_embedding", "text_centroid", "vector_centroid", "content_dedupe",
    "line_ranges", "blame_rank",
)
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = get_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "contract_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
