"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from ledgerkeep.plans import catalogue
from ledgerkeep.session import local_session

HEADLINE = [
    "a10_table_scan",
    "c2_idempotent_writes",
    "c3_replay_violations",
    "c4_active_view",
    "c10_consolidate",
    "d3_hashed_bag",
    "e1_vector_top_k",
    "e1_text_search",
    "f1_available_memories",
    "f3_historical_similarity",
    "g9_greedy_select",
    "g11_semantic_representatives",
    "g13_plan_table",
    "e5_storage_isolated_retrieval",
    "h1_ranking_metrics",
    "h7_repeated_labels",
    "h15_plan_summary",
    "h18_paired_bootstrap",
    "h21_failure_taxonomy",
    "h25_subset_scores",
    "h27_pairwise_interaction",
    "h32_latency_percentiles",
    "i4_ridge_fit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session("ledgerkeep-bench", cores=cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before timing
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
