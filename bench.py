"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR chooses the tables, BENCH_CPUS the cores.  Every query is computed in
full: all columns of all rows go to the no-op sink.  Before the timed run each query
runs once, untimed, on the smallest tables beside the chosen ones, so that class
loading and code generation are not part of the figures.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyforge.session import build_session  # noqa: E402
from workload import all_queries  # noqa: E402

HEADLINE = [
    "evaluate_experiments", "score_candidates", "pass_at_k", "mean_std_folds", "best_params",
    "category_comparison", "top5_categories", "error_funnel", "refinement_feedback",
    "transition_matrix", "refinement_summary",
    "layout_score", "overlap_pairs", "in_main_out_pairs", "nodes_at_flow",
    "label_distribution", "label_matrix", "lookup_node_doc",
    "kfold_split", "stratified_kfold", "multilabel_split",
    "coverage_select", "knn_topk", "context_plan", "build_prompts", "pca_2d",
    "token_budget_prefix", "ordered_concat", "prune_debug_history", "token_count",
    "extract_response_code", "extract_function_block", "extract_catalog", "parse_assertions",
    "explode_runs", "upsert_best_params", "quality_checks",
]


def run(query, spark, folder: str) -> None:
    query(spark, folder).write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("tallyforge-bench", f"local[{cpus}]", shuffle_partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    names = sys.argv[1:] or HEADLINE
    smallest = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest):
        for name in names:
            run(queries[name], spark, smallest)
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(queries[name], spark, folder)
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
