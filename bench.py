"""Time the registered queries: one JSON line with the median seconds of each.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default
8), BENCH_RUNS (default 3, after one warm-up run), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "events_latest", "events_search", "events_search_text", "events_near_many", "events_near_fleet",
    "events_pending_all", "events_semantic", "events_semantic_many", "system_history", "system_top_cpu",
    "system_samples_at_many", "system_samples_at_fleet", "system_top_at_many", "process_at",
    "system_rates", "system_rates_fleet", "system_trends_fleet", "system_rolling_cpu", "system_cpu_history",
    "system_state_at", "system_state_at_fleet", "system_snapshot_fleet", "samples_build",
    "processes_top_per_tick", "first_wins_processes", "journal_parse", "vector_import", "embed_pending",
]


def main() -> None:
    from timelens.plans.catalog import QUERIES
    from timelens.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    took: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
