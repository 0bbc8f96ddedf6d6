from __future__ import annotations

from playtally.operators.parse import known_events, parse_batches, parse_counts, parsed_events
from playtally.operators.rollups import by_minute, totals_direct
from playtally.operators.validate import accepted_events, untyped_events, verdicts, with_verdict
from playtally.options import IngestLimits
from tests.helpers import A, batch, event, events, one, rows


def parsed(spark, *elements):
    return parse_batches(batch(spark, list(elements)))


def test_what_is_no_event_is_counted_and_skipped(spark):
    frame = parsed(spark, event(), 7, None, {"event_type": "bogus"}, {}, {"event_type": 5}, event())
    assert one(parse_counts(frame)) == {"n_elements": 7, "n_events": 2, "parse_failures": 5}
    assert one(totals_direct(parsed_events(frame)))["total_views"] == 2


def test_wrong_types_read_as_absent(spark):
    row = rows(
        parsed(
            spark,
            {
                "event_type": "pause",
                "player": 5,
                "device": None,
                "session_id": ["x"],
                "timestamp": "5",
                "startup_time_ms": 1.9,
                "buffer_duration_ms": "5",
                "bitrate_kbps": True,
                "watch_time_ms": 1e3,
                "error_code": 7,
            },
        )
    )[0]
    assert (row["player"], row["device"], row["session_id"], row["timestamp_ms"]) == ("", "", "", 0)
    fields = ("startup_time_ms", "buffer_duration_ms", "bitrate_kbps", "watch_time_ms", "error_code")
    assert [row[f] for f in fields] == [None] * 5


def test_int32_overflow_leaves_the_event(spark):
    values = [4294967796, 8589934592, 2147483648, -2147483649, 2147483647, -2147483648]
    got = rows(parsed(spark, *[event(bitrate_kbps=v, watch_time_ms=v) for v in values]))
    assert [r["bitrate_kbps"] for r in got] == [None] * 4 + values[4:]
    assert [r["watch_time_ms"] for r in got] == values


def test_bodies_without_a_list_give_nothing(spark):
    frame = parse_batches(batch(spark, "{", {"data": [event()]}, "5", {"events": [event(timestamp=A)]}))
    assert [r["batch_id"] for r in rows(frame)] == ["3"]


def test_known_events(spark):
    assert known_events(events(spark, {}, {"event_type": "other"})).count() == 1


def test_times_without_a_minute_label_are_failures_not_errors(spark):
    stamps = (2**63 - 1, -(2**63), 4 * 10**14, -1, A)
    frame = parsed(spark, *[event(timestamp=t) for t in stamps])
    assert one(parse_counts(frame)) == {"n_elements": 5, "n_events": 1, "parse_failures": 4}
    assert [r["minute_ms"] for r in rows(by_minute(parsed_events(frame)))] == [A]


def test_untyped_elements_of_accepted_batches_are_no_events(spark):
    limits = IngestLimits(require_event_type=False)
    judged = with_verdict(batch(spark, [{"player": "p", "timestamp": A}, event(event_type="seek", player="q")]), limits)
    kept = accepted_events(judged)
    assert [(r["event_type"], r["player"]) for r in rows(kept)] == [("seek", "q")]
    assert one(judged.selectExpr(f"{untyped_events()} AS n")) == {"n": 1}


def test_ill_formed_text_is_no_json(spark):
    body = b'[{"event_type":"seek","player":"\xff"}]'
    frame = spark.createDataFrame([(body,)], "b binary").selectExpr(
        "'1' AS batch_id", f"{A}L AS ingest_time_ms", "CAST(b AS STRING) AS body"
    )
    assert [r["reason"] for r in rows(verdicts(frame))] == ["not_json"]
