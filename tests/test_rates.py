from __future__ import annotations

import random

from playtally.operators import gauge, rates, rollups
from playtally.plans.reads import PlaybackMetrics
from tests.helpers import A, events, one, rows

SCHEMA = "series string, ts_ms bigint, n bigint, value bigint"


def test_guards(spark):
    samples = [
        ("a", 0, 0, 100),
        ("a", 2000, 1, 300),
        ("a", 2000, 2, 400),
        ("a", 3000, 3, 50),
        ("a", 4000, 4, 60),
        ("b", 4000, 5, 9),
    ]
    got = rows(rates.counter_rate(spark.createDataFrame(samples, SCHEMA), tie="n").orderBy("n"))
    assert [r["rate"] for r in got] == [0.0, 100.0, 0.0, 0.0, 10.0, 0.0]


def test_slices_change_nothing(spark):
    rng = random.Random(3)
    samples = [
        (rng.choice("ab"), rng.randrange(0, 100_000), i, rng.randrange(1000)) for i in range(400)
    ]
    frame = spark.createDataFrame(samples, SCHEMA)
    key = lambda f: sorted((r["n"], r["rate"]) for r in rows(f))
    whole = key(rates.counter_rate(frame, tie="n", slice_ms=10**9))
    for width in (1, 500, 7000):
        assert key(rates.counter_rate(frame, tie="n", slice_ms=width)) == whole
    last, want = {}, {}
    for s, t, n, v in sorted(samples, key=lambda x: (x[1], x[2])):
        if s in last and t > last[s][0] and v >= last[s][1]:
            want[n] = (v - last[s][1]) / ((t - last[s][0]) / 1000.0)
        else:
            want[n] = 0.0
        last[s] = (t, v)
    assert whole == sorted(want.items())


def test_events_per_sec_counts_from_the_bucket_before(spark):
    frame = events(
        spark, *[{}] * 30, *[{"timestamp_ms": A + 120_000}] * 60, {"timestamp_ms": A + 86_400_000}
    )
    got = rows(rates.events_per_sec(rollups.by_minute(frame)).orderBy("minute_ms"))
    assert [r["running_events"] for r in got] == [30, 90, 91]
    assert [r["events_per_sec"] for r in got] == [0.0, 0.5, 1 / (86_400 - 120)]


def test_status_row(spark):
    frame = events(
        spark,
        {},
        {},
        {"event_type": "playback_end"},
        {"event_type": "drm_error", "timestamp_ms": A + 60_000},
    )
    assert one(PlaybackMetrics.from_events(frame).status()) == {
        "total_events": 4,
        "error_count": 1,
        "error_rate": 0.25,
        "events_per_sec": 1 / 60,
        "active_sessions": 1,
    }


def test_status_without_events(spark):
    none = events(spark, {}).limit(0)
    got = one(
        rates.status_row(
            rollups.by_minute(none), gauge.current_sessions(gauge.active_sessions(none))
        )
    )
    assert got == {
        "total_events": 0,
        "error_count": 0,
        "error_rate": 0.0,
        "events_per_sec": 0.0,
        "active_sessions": 0,
    }
