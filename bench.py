"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.registry import CHECKS  # noqa: E402
from tunelake.session import local_session  # noqa: E402

HEADLINE = [
    "generation_kpi",
    "runtime_summary",
    "run_summary",
    "resolve_jobs",
    "worker_idle_gap",
    "heartbeat_timeouts",
    "plateau_events",
    "wall_clock_guard",
    "rank_runs",
    "progress_bins",
    "seed_aggregate_series",
    "sweep_winners",
    "random_candidates",
    "tournament_select",
    "uniform_crossover",
    "adaptive_mutation",
    "narrow_constraints",
    "de_mutant",
    "evaluate_candidates",
    "random_search",
    "idempotent_submissions",
    "classify_commits",
    "replay_ledger",
    "evaluate_tool_plans",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the executors and the code generator.
    CHECKS["status_counts"].spark(spark, sf_dir).count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        CHECKS[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(Path(sf_dir).name.removeprefix("sf") or 0),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
