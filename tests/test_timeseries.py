from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from playtally.functions import minutes as M
from playtally.operators import rollups, timeseries
from playtally.options import QueryLimits
from playtally.plans.reads import PlaybackMetrics
from tests.helpers import A, B, events, one, rows

MINUTE = 60_000


def buckets(spark, *offsets):
    return rollups.by_minute(events(spark, *[{"timestamp_ms": A + o * MINUTE} for o in offsets]))


def at(frame):
    return [(r["minute_ms"] - A) // MINUTE for r in rows(frame)]


def test_buckets_by_event_time(spark):
    frame = rollups.by_minute(
        events(spark, {}, {"timestamp_ms": A + 30_000}, {"timestamp_ms": B})
    )
    assert {r["minute_ms"]: r["total_views"] for r in rows(frame)} == {A: 2, B: 1}


def test_absent_minute_is_no_row(spark):
    metrics = PlaybackMetrics.from_events(events(spark, {}))
    assert metrics.minute(915_148_800_000).count() == 0
    assert one(metrics.minute(A + 59_999))["total_views"] == 1


def test_recent_counts_existing_buckets_and_is_ascending(spark):
    minutes = buckets(spark, 4, 0, 3, 1, 9)
    assert at(timeseries.recent(minutes, 2)) == [4, 9]
    assert at(timeseries.recent(minutes, 50)) == [0, 1, 3, 4, 9]
    assert at(timeseries.recent(minutes, 0)) == []
    assert at(timeseries.ordered(minutes)) == [0, 1, 3, 4, 9]


def test_range_is_inclusive_and_cut_to_minutes(spark):
    frame = events(spark, *[{"timestamp_ms": A + i * MINUTE + 1} for i in range(5)])
    got = rows(PlaybackMetrics.from_events(frame).range(A + MINUTE + 59_000, A + 3 * MINUTE))
    assert [(r["minute_ms"] - A) // MINUTE for r in got] == [1, 2, 3]
    assert {(r["from_minute"], r["to_minute"]) for r in got} == {
        ("2026-07-20T14:04", "2026-07-20T14:06")
    }
    assert "buffer_ratio_per_view" not in got[0]


@pytest.mark.parametrize(
    ("asked", "n"),
    [
        (None, 15),
        ("abc", 15),
        ("", 15),
        ("0", 15),
        ("-3", 15),
        ("5", 5),
        (7, 7),
        ("+5", 15),
        (" 5", 15),
        ("5.0", 15),
        ("999999999", 1440),
        ("99999999999999999999", 15),
    ],
)
def test_live_argument(asked, n):
    assert timeseries.live_minutes(asked) == n


def test_live_is_capped(spark):
    frame = events(spark, *[{"timestamp_ms": A + i * MINUTE} for i in range(40)])
    metrics = PlaybackMetrics.from_events(frame, limits=QueryLimits(max_minutes=5))
    assert at(metrics.live("999999999")) == [35, 36, 37, 38, 39]


@pytest.mark.parametrize(
    ("low", "high", "message"),
    [
        (None, 5, "required"),
        (5, "x", "required"),
        (-1, 5, "within"),
        (0, M.MAX_TIMESTAMP_MS + 1, "within"),
        (10, 5, "after"),
        (0, M.MAX_TIMESTAMP_MS, "narrower"),
        (0, 1440 * MINUTE, "narrower"),
    ],
)
def test_range_arguments(low, high, message):
    with pytest.raises(ValueError, match=message):
        timeseries.range_bounds(low, high)


def test_range_at_the_limit():
    assert timeseries.range_bounds("0", 1440 * MINUTE - 1) == (0, 1440 * MINUTE - 1)


def test_fill_gaps(spark):
    filled = timeseries.fill_gaps(buckets(spark, 0, 3)).orderBy("minute_ms")
    assert at(filled) == [0, 1, 2, 3]
    assert [r["total_events"] for r in rows(filled)] == [1, 0, 0, 1]


@pytest.mark.parametrize("offsets", [(), (2,), (0, 1, 2), (0, 2000), (0, 5000)])
def test_nothing_to_fill_or_too_wide(spark, offsets):
    minutes = buckets(spark, *offsets) if offsets else buckets(spark, 0).limit(0)
    assert at(timeseries.fill_gaps(minutes, limit=2000).orderBy("minute_ms")) == list(offsets)


def test_fill_up_to_the_limit(spark):
    assert timeseries.fill_gaps(buckets(spark, 0, 1999), limit=2000).count() == 2000
    assert timeseries.fill_gaps(buckets(spark, 0, 2999)).count() == 3000


def test_window_mean_is_weighted_by_samples(spark):
    nine = [{"event_type": "startup_complete", "startup_time_ms": 1000}] * 9
    last = {"event_type": "startup_complete", "startup_time_ms": 10_000, "timestamp_ms": B}
    minutes = rollups.by_minute(events(spark, *nine, last))
    assert one(timeseries.window_totals(minutes))["startup_avg_ms"] == 1900.0


def test_kpi_panels_match_the_long_way(spark):
    minutes = buckets(spark, 0, 3, 7, 8, 20, 400)
    windows = {"two": 2, "four": 4, "all": 100}
    got = {r["window_name"]: r for r in rows(timeseries.kpi_panels(minutes, windows))}
    for name, n in windows.items():
        points = timeseries.fill_gaps(timeseries.recent(minutes, n))
        want = one(timeseries.window_totals(points))
        assert got[name].pop("points") == points.count()
        assert got[name].pop("window_name") == name
        assert got[name] == want
    single = one(timeseries.kpi_panel(minutes, 4))
    assert single.pop("points") == timeseries.fill_gaps(timeseries.recent(minutes, 4)).count()
    assert one(timeseries.kpi_panel(minutes.limit(0), 4))["points"] == 0


def test_segments_ranked(spark):
    frame = events(spark, *[{"player": p} for p in ("b", "c", "a", "c")])
    got = rows(PlaybackMetrics.from_events(frame).ranked("player", "total_views"))
    assert [(r["name"], r["value"]) for r in got] == [("c", 2), ("a", 1), ("b", 1)]
    with pytest.raises(ValueError, match="unknown metric"):
        timeseries.rank_segments(rollups.by_label(frame, "player"), "buffer_ratio_per_view")


def test_chart_series(spark):
    got = rows(timeseries.chart_series(buckets(spark, 1, 0, 0), "total_views"))
    assert [(r["label"], r["value"]) for r in got] == [("14:03", 2), ("14:04", 1)]


def test_minute_labels(spark):
    cases = {
        1_700_000_000_000: "2023-11-14T22:13",
        0: "1970-01-01T00:00",
        M.MAX_TIMESTAMP_MS: "9999-12-31T23:59",
        951_782_399_999: "2000-02-28T23:59",
        951_782_400_000: "2000-02-29T00:00",
    }
    ms = M.F.col("ms")
    frame = spark.createDataFrame([(k,) for k in cases], "ms bigint").select(
        "ms",
        M.iso_minute(ms).alias("label"),
        M.label_to_ms(M.iso_minute(ms)).alias("back"),
        M.minute_of(ms).alias("minute"),
        *M.calendar(ms),
    )
    for r in rows(frame):
        assert r["label"] == cases[r["ms"]]
        assert r["back"] == r["minute"] == r["ms"] - r["ms"] % MINUTE
        assert f"{r['y']:04d}-{r['mo']:02d}-{r['d']:02d}T{r['h']:02d}:{r['mi']:02d}" == r["label"]


def test_malformed_labels(spark):
    bad = ["", "2023-02-30T00:00", "2023-01-01T24:00", "2023-01-01 00:00", "2023-1-01T00:00", None]
    frame = spark.createDataFrame([(b,) for b in bad], "label string")
    assert {r["x"] for r in rows(frame.select(M.label_to_ms(M.F.col("label")).alias("x")))} == {None}


def test_time_domain(spark):
    values = [-1, 0, M.MAX_TIMESTAMP_MS, M.MAX_TIMESTAMP_MS + 1]
    frame = spark.createDataFrame([(v,) for v in values], "ms bigint")
    assert [r["ok"] for r in rows(frame.select(M.in_time_domain(M.F.col("ms")).alias("ok")))] == [
        False,
        True,
        True,
        False,
    ]


def test_labels_do_not_depend_on_the_session_time_zone(spark):
    frame = spark.createDataFrame([(1_700_000_000_000,)], "ms bigint")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(frame.select(M.iso_minute(M.F.col("ms")).alias("x")))["x"] == "2023-11-14T22:13"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_many_ranges_at_once(spark):
    """Every request as a single range read has it, and its reason where that one refuses."""
    rnd = random.Random(6)
    made = events(spark, *[{"timestamp_ms": A + rnd.randrange(9000) * 60_000, "player": "p"} for _ in range(300)])
    limits = QueryLimits(max_minutes=400)
    asked = []
    for i in range(60):
        low = A + rnd.randrange(9000) * 60_000 + rnd.randrange(60_000)
        asked.append((i, str(low), str(low + rnd.choice([0, 1, 59, 60, 61, 119, 300, 399]) * 60_000)))
    asked += [(100, "x", "1"), (101, None, "5"), (102, "5", None), (103, "-1", "5"), (104, "9", "3"), (105, "0", "99999999999999999999")]
    asked += [(106, "0", str(400 * 60_000)), (107, "0", str(400 * 60_000 - 1)), (108, " 5", "9"), (109, "007", "8"), (None, "1", "2")]
    asked += [(110, "0", "253402300800000"), asked[0]]
    frame = spark.createDataFrame(asked, "request_id int, from_ms string, to_ms string").withColumn("lo", F.lit("clash"))
    minutes = rollups.by_minute(made)
    got = {r["request_id"]: r for r in rows(timeseries.range_requests(minutes, frame, limits))}
    assert len(got) == len(asked) - 1
    metrics = PlaybackMetrics.from_events(made, limits=limits)
    reasons = {"required": "missing_bound", "lie within": "out_of_domain", "after": "reversed", "covers": "too_wide"}
    for request, low, high in asked:
        row = got[request]
        try:
            want = rows(metrics.range(low, high)) if request is None or request < 8 or request > 99 else None
        except ValueError as refused:
            assert row["outcome"] == next(v for k, v in reasons.items() if k in str(refused))
            assert row["buckets"] == 0 and row["from_minute"] is None
            continue
        assert row["outcome"] == "ok"
        if want is not None:
            assert (row["buckets"], row["total_events"]) == (len(want), sum(w["total_events"] for w in want))
            assert not want or (row["from_minute"], row["to_minute"]) == (want[0]["from_minute"], want[0]["to_minute"])
    assert timeseries.range_requests(minutes, frame.limit(0)).count() == 0
    assert {r["buckets"] for r in rows(timeseries.range_requests(minutes.limit(0), frame))} == {0}


def test_ranges_are_few_pieces(spark):
    """However long, a range is looked up at its ends: hours, days and their borders, over gaps."""
    rnd = random.Random(8)
    at = sorted({rnd.randrange(4 * 1440) for _ in range(150)} | {0, 59, 60, 1439, 1440, 2880})
    day = A // 86_400_000 * 86_400_000
    minutes = rollups.by_minute(events(spark, *[{"timestamp_ms": day + m * 60_000} for m in at]))
    marks = [0, 1, 59, 60, 61, 119, 120, 1379, 1380, 1439, 1440, 1441, 1499, 1500, 2879, 2880, 2881, 4319, 4320, 5759]
    spans = [(a, b) for a in marks for b in marks if a <= b]
    asked = [(i, str(day + a * 60_000), str(day + b * 60_000)) for i, (a, b) in enumerate(spans)]
    frame = spark.createDataFrame(asked, "request_id int, from_ms string, to_ms string")
    got = {r["request_id"]: r for r in rows(timeseries.range_requests(minutes, frame, QueryLimits(max_minutes=9000)))}
    for i, (a, b) in enumerate(spans):
        want = sum(a <= m <= b for m in at)
        assert (got[i]["outcome"], got[i]["buckets"], got[i]["total_events"]) == ("ok", want, want), (a, b)
    cut = spark.createDataFrame(spans, "a bigint, b bigint").selectExpr("a", "b", f"size({timeseries._pieces()}) AS n")
    assert all(r["n"] <= 4 + r["b"] // 1440 - r["a"] // 1440 for r in rows(cut))
    # A minute in several rows counts as often; what lies before the domain belongs to no range.
    twice = minutes.unionByName(minutes).unionByName(minutes.limit(1).withColumn("minute_ms", F.lit(-60_000).cast("bigint")))
    early = frame.unionByName(spark.createDataFrame([(-1, "0", "3599999")], frame.schema))
    for r in rows(timeseries.range_requests(twice, early, QueryLimits(max_minutes=9000))):
        assert r["total_events"] == (2 * got[r["request_id"]]["total_events"] if r["request_id"] >= 0 else 0)
