"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR  folder of tables (default /root/testdata/sf0.1)
    BENCH_CPUS    threads (default 8)
    BENCH_RUNS    timed runs per query; the fastest counts (default 2, after one warm-up)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugework.plans.all import QUERIES  # noqa: E402
from gaugework.session import local_session  # noqa: E402

HEADLINES = [
    "config_summary", "latency_percentiles", "request_cost", "run_throughput", "box_summary",
    "config_metrics", "batch_experiment", "run_result_store", "constrained_selection",
    "pareto_lines", "pareto_lines_four_objectives", "positional_ranks", "task_accuracy",
    "rouge_l", "prompt_building", "report_tables", "stream_latency_windows",
    "composite_summary", "quantization_performance", "constraint_funnel", "frontier_by_slabs",
    "batch_assignment", "consistency", "stream_sliding_p95", "stream_run_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINES
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in names:
        best = float("inf")
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt:
                best = min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
