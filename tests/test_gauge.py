from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from playtally.operators import gauge
from tests.helpers import A, events, one, rows

START, END = {"event_type": "video_start"}, {"event_type": "playback_end"}


def naive(steps):
    """(minute -> gauge) by walking the steps."""
    level, seen = 0, {}
    for kind, ts, _ in sorted(steps, key=lambda s: (s[1], s[2])):
        if kind == "video_start":
            level += 1
        elif kind == "playback_end":
            level = max(level - 1, 0)
        else:
            continue
        seen[ts - ts % 60_000] = level
    return seen


def test_ends_without_starts_do_not_go_below_zero(spark):
    frame = events(spark, END, END, END, START, START)
    assert one(gauge.current_sessions(gauge.active_sessions(frame))) == {"active_sessions": 2}


def test_no_steps(spark):
    frame = events(spark, {"event_type": "pause"})
    assert one(gauge.current_sessions(gauge.active_sessions(frame))) == {"active_sessions": 0}


def test_same_as_walking_the_steps(spark):
    rng = random.Random(7)
    for spread in (30_000, 600_000, 10 * 86_400_000):
        steps = [
            (
                rng.choice(["video_start", "playback_end", "playback_end", "pause"]),
                A + rng.randrange(spread),
                i,
            )
            for i in range(1500)
        ]
        frame = events(
            spark, *[{"event_type": k, "timestamp_ms": t, "event_id": i} for k, t, i in steps]
        ).repartition(7)
        got = {r["minute_ms"]: r["active_sessions"] for r in rows(gauge.active_sessions(frame))}
        assert got == naive(steps)


def test_hot_minute_is_split_over_tasks(spark):
    frame = spark.range(200_000, numPartitions=4).select(
        F.lit(A).alias("timestamp_ms"),
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "playback_end").otherwise("video_start").alias("event_type"),
    )
    runs = rows(gauge.session_runs(frame))
    assert len(runs) > 1
    assert max(r["moves"] for r in runs) < 100_000
    level = 0
    for i in range(200_000):
        level = max(level - 1, 0) if i % 3 == 0 else level + 1
    assert one(gauge.current_sessions(gauge.active_sessions(frame)))["active_sessions"] == level


def test_runs_continue_over_arrow_batches():
    minutes = np.array([0, 0, 60, 60, 60, 120], dtype=np.int64)
    steps = np.array([1, -1, -1, -1, 1, 1], dtype=np.int64)

    def fold(cuts):
        parts = zip([0, *cuts], [*cuts, 6])
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array(a[i:j]) for a in (minutes, steps)], names=["minute_ms", "step"]
            )
            for i, j in parts
        ]
        return [r for b in gauge._fold_runs(iter(batches)) for r in b.to_pylist()]

    want = fold([])
    assert [(r["minute_ms"], r["net"], r["lowest"], r["moves"]) for r in want] == [
        (0, 0, 0, 2),
        (60, -1, -2, 3),
        (120, 1, 1, 1),
    ]
    assert [r["seq"] for r in want] == [0, 1, 2]
    for cuts in ([1], [2], [3], [1, 2, 3, 4, 5], [3, 3, 4]):
        assert fold(cuts) == want


def arrivals(spark, *steps):
    """(kind, minute offset, receipt time, batch, position) as events."""
    rows_ = [(k, A + 60_000 * m, r, b, i) for k, m, r, b, i in steps]
    return spark.createDataFrame(
        rows_, "event_type string, timestamp_ms bigint, ingest_time_ms bigint, batch_id string, idx int"
    )


def test_arrival_order_is_not_event_time(spark):
    # The end arrives first and takes nothing away.
    late = arrivals(spark, ("video_start", 0, 2, "a", 0), ("playback_end", 1, 1, "a", 0))
    by_arrival = gauge.current_sessions(gauge.active_sessions(late, gauge.ARRIVAL))
    assert one(by_arrival) == {"active_sessions": 1}
    by_time = gauge.current_sessions(gauge.active_sessions(late, ("timestamp_ms", *gauge.ARRIVAL)))
    assert one(by_time) == {"active_sessions": 0}


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    # Two batches of one millisecond, the same position: the batch decides.
    steps = [("video_start", 0, 5, "b", 0), ("playback_end", 0, 5, "a", 0), ("video_start", 1, 5, "b", 1)]
    for turned in (steps, steps[::-1], steps[1:] + steps[:1]):
        got = gauge.active_sessions(arrivals(spark, *turned), gauge.ARRIVAL)
        assert {r["minute_ms"]: r["active_sessions"] for r in rows(got)} == {A: 1, A + 60_000: 2}


def test_a_minute_that_comes_up_again_counts_at_its_last_step(spark):
    steps = [("video_start", 0, 1, "a", 0), ("video_start", 1, 2, "a", 0), ("playback_end", 0, 3, "a", 0)]
    got = gauge.active_sessions(arrivals(spark, *steps), gauge.ARRIVAL)
    assert {r["minute_ms"]: r["active_sessions"] for r in rows(got)} == {A: 1, A + 60_000: 2}
    assert one(gauge.current_sessions(got)) == {"active_sessions": 1}
