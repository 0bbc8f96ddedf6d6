"""Time the headline queries and print one JSON line.

Reads ``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]``. Every query
is run once to warm up and then timed; the value is the sum of the times.
Results are consumed in full by a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from playtally.plans.registry import registry
from playtally.session import local_session

HEADLINE = (
    "minute_rollup",
    "multi_rollup",
    "totals_direct",
    "by_player",
    "by_device",
    "capped_players",
    "live_recent",
    "minute_range",
    "fill_gaps",
    "kpi_panel",
    "active_sessions",
    "counter_rate",
    "session_audit",
    "status_row",
    "verdicts",
    "ingest_accept",
    "snapshot_roundtrip",
    "restore_additive",
)
REPEATS = 2


def consume(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        run = registry()[name]
        consume(run(spark, sf_dir))
        best = float("inf")
        for _ in range(REPEATS):
            started = time.perf_counter()
            consume(run(spark, sf_dir))
            best = min(best, time.perf_counter() - started)
        times[name] = round(best, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": events,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
