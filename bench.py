"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then up to $BENCH_REPEATS times (2 by default, one once it has used 20 seconds); the
best of the warm runs is reported, with a warm run at sf0.01 beside it. A run is
the whole query, its preparatory jobs included, with the result written to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from rankscreen import scratch
from rankscreen.catalog import ENTRIES
from rankscreen.session import local_session

HEADLINE = [
    "ranking_report", "bootstrap_intervals", "label_noise_ceiling", "average_tie_ranks", "label_measurements",
    "sequential_stopping", "assembled_measurements", "treatment_tally", "paired_contingency", "reconciled_join",
    "table_digest", "balanced_sample", "population_projection", "cycle_counts", "merged_mechanisms",
]


def timed(spark, name: str, sf_dir: str, repeats: int) -> float:
    runs, began = [], time.perf_counter()
    while len(runs) <= repeats and (len(runs) < 2 or time.perf_counter() - began <= 20):
        start = time.perf_counter()
        ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - start)
    scratch.release(spark)
    return round(min(runs[1:]), 3)


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "2")))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS"))
    times: dict[str, float] = {}
    for name in names:
        times[name] = timed(spark, name, sf_dir, repeats)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    beside = {name: timed(spark, name, small, 1) for name in names} if os.path.isdir(small) else {}
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "queries_sf0.01": beside, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
