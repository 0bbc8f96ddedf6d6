from __future__ import annotations

import json

import pytest

from playtally.operators import rates
from playtally.operators.validate import (
    accepted_events,
    scan_shape,
    verdict_counts,
    verdicts,
    with_verdict,
    within_freshness,
)
from playtally.options import DAY_MS, IngestLimits
from tests.helpers import A, batch, event, events, one, rows

NOW = A + 1000
BIG = 2**63


def judge(spark, body, limits=IngestLimits(), now=NOW):
    return one(verdicts(batch(spark, body, ingest_time_ms=now), limits))


def reasons(spark, bodies, limits=IngestLimits(), now=NOW):
    """Reasons of many bodies in one job, in order."""
    judged = verdicts(batch(spark, *bodies, ingest_time_ms=now), limits)
    found = {int(r["batch_id"]): r for r in rows(judged)}
    return [found[i]["reason"] for i in range(len(bodies))]


def test_plausible_batch_is_accepted(spark):
    row = judge(
        spark,
        [
            event(session_id="s", player="ExoPlayer", device="TV"),
            event(event_type="startup_complete", startup_time_ms=850),
            event(event_type="buffer_end", buffer_duration_ms=0),
            event(event_type="seek", seek_to_ms=12_000, extra={"deep": [1, {"x": None}]}),
            event(event_type="drm_error", error_code="E1"),
        ],
    )
    assert (row["status"], row["http_status"], row["n_events"]) == ("accepted", 202, 5)
    assert row["first_idx"] is None and row["reason"] is None


def test_envelopes_and_shapes(spark):
    got = reasons(
        spark,
        [
            {"events": [event()]},
            {"events": [event()], "sent_by": "sdk"},
            {"data": [event()]},
            {"events": 5},
            {"events": None},
            {"events": {}},
            "5",
            "null",
            '"text"',
            "[]",
            {"events": []},
            [5],
            [None],
            [event(), [event()]],
        ],
    )
    assert got == [
        None,
        None,
        "no_events",
        "events_not_a_list",
        "events_not_a_list",
        "events_not_a_list",
        "no_events",
        "no_events",
        "no_events",
        "no_event",
        "no_event",
        "not_an_object",
        "not_an_object",
        "not_an_object",
    ]


def test_text_that_is_no_json(spark):
    ok = json.dumps([event()])
    bodies = ["", "   ", "[", ok[:-1], ok + " x", ok + ok, ok + ",0", "{'a':1}", "[1,]", ok + "],[1"]
    assert reasons(spark, bodies) == ["not_json"] * len(bodies)
    padded = ["  " + ok + " \n", "﻿" + ok]
    assert reasons(spark, padded) == [None, None]
    row = judge(spark, "[")
    assert (row["status"], row["http_status"], row["n_events"]) == ("invalid_json", 400, 0)


def test_repeated_member_keeps_the_last_value(spark):
    bodies = [
        '[{"event_type":"bogus","event_type":"pause","timestamp":%d}]' % A,
        '[{"event_type":"pause","event_type":"bogus","timestamp":%d}]' % A,
    ]
    assert reasons(spark, bodies) == [None, "unknown_event_type"]


def test_event_type(spark):
    bodies = [
        [{"timestamp": A}],
        [event(event_type="")],
        [event(event_type=None)],
        [event(event_type=7)],
        [event(event_type="Video_Start")],
        [event(event_type="rebuffer")],
    ]
    missing, unknown = "missing_event_type", "unknown_event_type"
    assert reasons(spark, bodies) == [missing, missing, missing, missing, unknown, unknown]
    lenient = IngestLimits(require_event_type=False)
    assert reasons(spark, bodies, lenient) == [None, missing, missing, missing, unknown, unknown]


def test_timestamp_type(spark):
    values = [A, None, 1.0, "5", True, [A], 1e3]
    bodies = [[event(timestamp=v)] for v in values] + ['[{"event_type":"pause"}]']
    bad = "non_integer_timestamp"
    assert reasons(spark, bodies) == [None, bad, bad, bad, bad, bad, bad, None]


def test_freshness_window_is_inclusive(spark):
    week, skew = 7 * DAY_MS, 300_000
    values = [NOW - week, NOW - week - 1, NOW + skew, NOW + skew + 1, 0, -1, BIG]
    outside = "timestamp_outside_window"
    got = reasons(spark, [[event(timestamp=v)] for v in values])
    assert got[:6] == [None, outside, None, outside, outside, outside]
    assert got[6] is not None


def test_freshness_bounds_do_not_overflow(spark):
    limits = IngestLimits(max_lateness_ms=2**62, max_future_skew_ms=2**62)
    for now in (-(2**63) + 5, 2**63 - 5, 0):
        assert judge(spark, [event(timestamp=now)], limits, now)["status"] == "accepted"


def test_label_length_counts_bytes(spark):
    bodies = [
        [event(player="x" * 128)],
        [event(player="x" * 129)],
        [event(device="é" * 64)],
        [event(device="é" * 64 + "x")],
        [event(player=5, device=None)],
        [event(session_id="x" * 1000)],
    ]
    assert reasons(spark, bodies) == [
        None,
        "player_label_too_long",
        None,
        "device_label_too_long",
        None,
        None,
    ]


@pytest.mark.parametrize(
    ("field", "largest"),
    [
        ("startup_time_ms", 600_000),
        ("buffer_duration_ms", 3_600_000),
        ("bitrate_kbps", 1_000_000),
        ("watch_time_ms", 86_400_000),
    ],
)
def test_numeric_ranges_hold_for_every_event_type(spark, field, largest):
    values = [0, largest, largest + 1, -1, 1.5, "7", None, 10**30, BIG]
    got = reasons(spark, [[event(event_type="pause", **{field: v})] for v in values])
    off, odd = f"{field}_out_of_range", f"non_integer_{field}"
    assert got[:7] == [None, None, off, off, odd, odd, odd]
    assert got[7] is not None and got[8] is not None


def test_first_fault_by_index_then_by_check(spark):
    row = judge(
        spark,
        [event(), event(player="x" * 200, startup_time_ms=-1), event(event_type="bogus")],
    )
    assert (row["first_idx"], row["reason"]) == (1, "player_label_too_long")
    assert "element 1" in row["message"]
    row = judge(spark, [event(event_type="bogus", timestamp="x", player="x" * 200)])
    assert row["reason"] == "unknown_event_type"


def test_size_cap_is_inclusive_and_counts_bytes(spark):
    body = json.dumps([event(session_id="é")], ensure_ascii=False)
    size = len(body.encode())
    assert judge(spark, body, IngestLimits(max_body_bytes=size))["status"] == "accepted"
    row = judge(spark, body + " ", IngestLimits(max_body_bytes=size))
    assert (row["status"], row["http_status"]) == ("too_large", 413)


def test_batch_size_cap(spark):
    limits = IngestLimits(max_events_per_batch=3)
    bodies = [[event()] * 3, [event()] * 4, [event(note=None)] * 4]
    assert reasons(spark, bodies, limits) == [None, "too_many_events", "too_many_events"]
    assert judge(spark, [event()] * 4, limits)["n_events"] == 4


def test_depth_cap(spark):
    nested = lambda n: "[" * n + "]" * n
    wrap = lambda inner: '[{"event_type":"pause","x":%s}]' % inner
    bodies = [wrap(nested(30)), wrap(nested(31)), nested(33), "[" * 40, wrap('"' + nested(60) + '\\"[[["')]
    assert reasons(spark, bodies) == [None, "too_deep", "too_deep", "too_deep", None]
    assert reasons(spark, [[event()]], IngestLimits(max_json_depth=2)) == [None]
    assert reasons(spark, [[event()]], IngestLimits(max_json_depth=1)) == ["too_deep"]


def test_depth_beyond_the_parser(spark):
    assert reasons(spark, ["[" * 5000 + "]" * 5000]) == ["too_deep"]


def test_breadth_cap_comes_before_depth_and_parsing(spark):
    limits = IngestLimits(max_structural_tokens=100)
    flat = "[" + "0," * 200 + "0]"
    row = judge(spark, flat, limits)
    assert (row["reason"], row["http_status"]) == ("too_many_tokens", 422)
    assert reasons(spark, ["[" * 101, "," * 101, '["' + "," * 500 + '"]'], limits) == [
        "too_many_tokens",
        "too_many_tokens",
        "not_an_object",
    ]
    assert reasons(spark, ["[" + "0," * 98 + "0]"], limits) == ["not_an_object"]


def test_large_hostile_bodies(spark):
    million = "[" + "0," * 1_000_000 + "0]"
    long_string = '[{"event_type":"pause","session_id":"' + "a" * 2_000_000 + '"}]'
    unterminated = '["' + "[" * 300_000
    escaped = '[{"event_type":"pause","session_id":"' + "\\\\" * 200_000 + '"}]'
    assert reasons(spark, [million, long_string, unterminated, escaped]) == [
        "too_many_tokens",
        None,
        "not_json",
        None,
    ]


def test_scan_shape(spark):
    got = {
        r["batch_id"]: (r["n_tokens"], r["depth"])
        for r in rows(scan_shape(batch(spark, '[{"a":"[,]"}]', "]][[", '"\\"[', "")))
    }
    assert got == {"0": (4, 2), "1": (4, 2), "2": (0, 0), "3": (0, 0)}


def test_missing_timestamp_is_receipt_time_and_labels_may_be_odd(spark):
    judged = with_verdict(
        batch(spark, [{"event_type": "pause", "player": 5}, event(player="p", watch_time_ms=9)])
    )
    first, second = rows(accepted_events(judged).orderBy("idx"))
    assert (first["timestamp_ms"], first["player"], first["session_id"]) == (NOW, "", "")
    assert (second["timestamp_ms"], second["player"], second["watch_time_ms"]) == (A, "p", 9)
    assert second["startup_time_ms"] is None


def test_one_bad_event_rejects_the_whole_batch(spark):
    judged = with_verdict(
        batch(spark, [event(), event(event_type="nope")], [event(), event()], "[]", None or "{")
    )
    assert accepted_events(judged).count() == 2
    counts = {r["status"]: (r["n_batches"], r["n_events"]) for r in rows(verdict_counts(judged))}
    assert counts == {"accepted": (1, 2), "invalid_schema": (2, 2), "invalid_json": (1, 0)}
    assert one(rates.ingest_stats(judged)) == {
        "batches": 4,
        "accepted_batches": 1,
        "rejected_batches": 3,
        "events": 2,
        "unparseable_batches": 1,
    }


def test_filter_on_status_gives_the_same_rows(spark):
    judged = with_verdict(batch(spark, [event()], "[]"))
    assert [r["batch_id"] for r in rows(judged.where("status = 'accepted'"))] == ["0"]


def test_null_body(spark):
    frame = spark.createDataFrame([("0", 1, None)], "batch_id string, ingest_time_ms bigint, body string")
    assert one(verdicts(frame))["status"] == "invalid_json"


def test_within_freshness(spark):
    frame = events(
        spark, {"timestamp_ms": NOW - 7 * DAY_MS}, {"timestamp_ms": NOW - 7 * DAY_MS - 1}
    ).selectExpr("*", f"{NOW}L AS ingest_time_ms")
    assert within_freshness(frame).count() == 1
