"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each query is run once to warm up and then timed as the median of $BENCH_RUNS
runs, results written to Spark's ``noop`` sink so that every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, ROOT)

from boxwise.plans.registry import QUERIES  # noqa: E402
from boxwise.session import local_session  # noqa: E402

HEADLINE = [
    "own_window", "season_to_date", "against_position", "entity_trend", "stat_ranges", "serve_basic", "interval_baseline", "roster_combos", "roster_dp",
    "output_trend", "splits", "asof_latest", "reflection", "possession_box", "feature_matrix", "zone_chart",
    "cityblock_rank", "substitute", "team_running", "position_blend",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
