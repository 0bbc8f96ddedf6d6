from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from playtally.functions.counters import as_metrics
from playtally.operators import rollups
from playtally.schema import COUNTERS, EVENT_TYPES, METRICS, MINUTE_METRICS
from tests.helpers import A, B, counters, events, one, rows


def test_mixed_fold(spark):
    frame = events(
        spark,
        {"event_type": "resume"},
        {},
        {},
        {"event_type": "startup_complete", "startup_time_ms": 300},
        {"event_type": "startup_complete", "startup_time_ms": 500},
        {"event_type": "buffer_start"},
        {"event_type": "buffer_end", "buffer_duration_ms": 40},
        {"event_type": "buffer_end", "buffer_duration_ms": 60},
        {"event_type": "bitrate_change", "bitrate_kbps": 700},
        {"event_type": "drm_error"},
        {"event_type": "drm_error"},
        {"event_type": "playback_end", "watch_time_ms": 90_000},
    )
    row = one(as_metrics(rollups.totals_direct(frame)))
    assert row == {
        "total_events": 12,
        "total_views": 2,
        "startup_samples": 2,
        "startup_avg_ms": 400.0,
        "buffer_count": 1,
        "buffer_samples": 2,
        "buffer_avg_ms": 50.0,
        "buffer_ratio_per_view": 0.5,
        "error_count": 2,
        "watch_time_ms": 90_000,
        "watch_time_min": 1.5,
        "bitrate_samples": 1,
        "bitrate_avg_kbps": 700.0,
    }


def test_no_events_is_one_row_of_zeroes(spark):
    row = one(as_metrics(rollups.totals_direct(events(spark).limit(0))))
    assert set(row.values()) == {0}
    assert row["startup_avg_ms"] == 0.0


def test_negative_and_missing_payloads_are_no_samples(spark):
    frame = events(
        spark,
        {"event_type": "startup_complete", "startup_time_ms": -5},
        {"event_type": "buffer_end", "buffer_duration_ms": -3000},
        {"event_type": "playback_end", "watch_time_ms": -60_000},
        {"event_type": "startup_complete"},
        {"event_type": "bitrate_change"},
    )
    row = one(rollups.totals_direct(frame))
    assert row["total_events"] == 5
    assert {k: v for k, v in row.items() if v} == {"total_events": 5}


def test_payload_of_another_type_does_not_count(spark):
    row = one(rollups.totals_direct(events(spark, {"event_type": "pause", "startup_time_ms": 9})))
    assert row["startup_samples"] == 0 and row["startup_time_ms_sum"] == 0


def test_stall_across_minutes(spark):
    frame = events(
        spark,
        {"event_type": "buffer_start", "timestamp_ms": B - 100},
        {"event_type": "buffer_start", "timestamp_ms": B - 50},
        {"event_type": "buffer_end", "timestamp_ms": B + 100, "buffer_duration_ms": 1000},
        {"event_type": "buffer_end", "timestamp_ms": B + 200, "buffer_duration_ms": 1000},
    )
    minutes = rollups.by_minute(frame)
    got = {
        r["minute_ms"]: (r["buffer_count"], r["buffer_samples"], r["buffer_avg_ms"])
        for r in rows(as_metrics(minutes, ("minute_ms",), with_ratio=False))
    }
    assert got == {A: (2, 0, 0.0), B: (0, 2, 1000.0)}
    total = one(as_metrics(rollups.totals(minutes)))
    assert (total["buffer_count"], total["buffer_samples"], total["buffer_avg_ms"]) == (2, 2, 1000.0)


def test_abandoned_stall_is_not_in_the_mean(spark):
    frame = events(
        spark,
        {"event_type": "buffer_start"},
        {"event_type": "buffer_end", "buffer_duration_ms": 800},
        {"event_type": "buffer_start"},
    )
    row = one(as_metrics(rollups.totals_direct(frame)))
    assert (row["buffer_count"], row["buffer_samples"], row["buffer_avg_ms"]) == (2, 1, 800.0)


def test_segments_skip_the_empty_label(spark):
    frame = events(
        spark, {"player": "ExoPlayer"}, {"player": "AVPlayer"}, {"player": "ExoPlayer"}, {}
    )
    got = [(r["name"], r["total_views"]) for r in rows(rollups.by_label(frame, "player").orderBy("name"))]
    assert got == [("AVPlayer", 1), ("ExoPlayer", 2)]


def test_minute_of_an_event_before_the_epoch_floors(spark):
    got = [r["minute_ms"] for r in rows(rollups.by_minute(events(spark, {"timestamp_ms": -1})))]
    assert got == [-60_000]


def test_result_contracts(spark):
    minutes = rollups.by_minute(events(spark, {}))
    assert as_metrics(minutes).columns == METRICS.names
    assert as_metrics(minutes, with_ratio=False).columns == MINUTE_METRICS.names
    assert [f.dataType for f in as_metrics(minutes).schema] == [f.dataType for f in METRICS]


@settings(
    max_examples=8,
    deadline=None,
    derandomize=True,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    st.lists(
        st.tuples(
            st.sampled_from(EVENT_TYPES),
            st.integers(A, A + 300_000),
            st.sampled_from(["", "p", "q"]),
            st.sampled_from(["", "d"]),
            st.one_of(st.none(), st.integers(-5, 900)),
        ),
        max_size=40,
    ),
    st.integers(0, 40),
)
def test_rollup_of_a_union_is_the_merge_of_rollups(spark, sample, cut):
    made = [
        {
            "event_type": kind,
            "timestamp_ms": ts,
            "player": player,
            "device": device,
            "startup_time_ms": v,
            "buffer_duration_ms": v,
            "bitrate_kbps": v,
            "watch_time_ms": v,
        }
        for kind, ts, player, device, v in sample
    ]
    whole = rollups.multi_rollup(events(spark, *made))
    parts = rollups.multi_rollup(events(spark, *made[:cut])).unionByName(
        rollups.multi_rollup(events(spark, *made[cut:]))
    )
    keyed = lambda f: {
        (r["grain"], r["minute_ms"], r["name"]): tuple(r[c] for c in COUNTERS) for r in f.collect()
    }
    expected = keyed(whole)
    assert keyed(rollups.merge_multi(parts)) == expected
    labelled = sum(v[0] for k, v in expected.items() if k[0] == "player")
    assert labelled == sum(1 for m in made if m["player"])
    assert sum(v[0] for k, v in expected.items() if k[0] == "minute") == len(made)
    assert counters(rollups.minutes_of(whole)) == counters(
        rollups.by_minute(events(spark, *made)).drop("minute_ms")
    )


def test_folding_combinations_first_changes_nothing(spark):
    rnd = random.Random(8)
    types = ("video_start", "startup_complete", "buffer_start", "buffer_end", "drm_error", "playback_end", "bitrate_change")
    made = [
        {
            "event_type": rnd.choice(types),
            "player": rnd.choice(("", "a", "b", "é")),
            "device": rnd.choice(("", "tv", "a")),
            "timestamp_ms": A + rnd.randrange(5) * 60_000 + rnd.randrange(60_000),
            "startup_time_ms": rnd.choice((None, -1, 5)),
            "buffer_duration_ms": rnd.choice((None, 7)),
            "watch_time_ms": rnd.choice((None, 11)),
            "bitrate_kbps": rnd.choice((None, 900)),
        }
        for _ in range(400)
    ]
    typed = events(spark, *made)
    plain, folded = (sorted(map(tuple, rollups.multi_rollup(typed, f).collect()), key=str) for f in (False, True))
    assert plain == folded and len(plain) == 5 + 3 + 2
    none = typed.limit(0)
    assert rollups.multi_rollup(none, fold_first=True).count() == 0
    assert not rollups.folds_well(none)
    assert rollups.folds_well(typed, least=6) and not rollups.folds_well(typed, least=7)
    assert not rollups.folds_well(typed, rows=20, least=6)
