from __future__ import annotations

from playtally.operators import labels, rollups
from playtally.options import RollupOptions
from tests.helpers import A, events, one, rows

ARRIVAL = "event_id"

def views(frame):
    return {r["name"]: r["total_views"] for r in rows(frame)}


def capped(frame, n, **kw):
    return views(labels.capped_rollup(frame, "player", ARRIVAL, RollupOptions(max_segments=n), **kw))


def test_first_labels_keep_their_row_and_nothing_is_lost(spark):
    frame = events(spark, *[{"player": f"p{i:02d}"} for i in range(50)])
    got = capped(frame, 3)
    assert got == {"p00": 1, "p01": 1, "p02": 1, "__other__": 47}


def test_many_labels(spark):
    frame = events(spark, *[{"player": f"p{i}"} for i in range(5000)])
    got = capped(frame, 10)
    assert len(got) == 11 and sum(got.values()) == 5000


def test_both_ways_agree(spark):
    frame = events(spark, *[{"player": f"p{i % 37}"} for i in range(500)])
    wide = RollupOptions(max_segments=9, broadcast_segments=0)
    assert views(labels.capped_rollup(frame, "player", ARRIVAL, wide)) == capped(frame, 9)


def test_reserved_name_takes_no_slot_and_has_one_row(spark):
    frame = events(spark, {"player": "__other__"}, {"player": "real"})
    assert capped(frame, 4) == {"__other__": 1, "real": 1}
    assert capped(frame, 1) == {"__other__": 1, "real": 1}


def test_under_the_cap_there_is_no_shared_row(spark):
    assert capped(events(spark, {"player": "a"}, {"player": ""}), 3) == {"a": 1}


def test_overflow_counts_folds_not_names(spark):
    frame = events(
        spark,
        *[{"player": p, "device": "d"} for p in ("a", "b", "c", "c", "__other__", "")],
    )
    got = one(labels.segment_overflows(frame, ARRIVAL, RollupOptions(max_segments=1)))
    assert got == {"segment_overflows": 3}


def test_arrival_key_orders_by_receipt_then_position(spark):
    frame = events(spark, {"player": "late"}, {"player": "second"}, {"player": "first"}).selectExpr(
        "*",
        f"CASE player WHEN 'late' THEN {A + 1}L ELSE {A}L END AS ingest_time_ms",
        "CASE player WHEN 'second' THEN 10001 ELSE 0 END AS idx",
        "'b' AS batch_id",
    )
    for n, kept in ((1, {"first"}), (2, {"first", "second"})):
        got = labels.tracked_labels(frame, "player", labels.arrival_key(), RollupOptions(max_segments=n))
        assert {r["name"] for r in rows(got)} == kept


def test_restored_labels_come_first_and_are_added(spark):
    restored = rollups.by_label(
        events(spark, {"player": "old1"}, {"player": "old2"}, {"player": "__other__"}), "player"
    )
    live = events(spark, {"player": "new1"}, {"player": "old1"}, {"player": "new2"})
    assert capped(live, 3, restored=restored) == {"old1": 2, "old2": 1, "new1": 1, "__other__": 2}
    assert capped(live, 1, restored=restored) == {"old1": 2, "__other__": 4}


def test_positions_beyond_any_batch_stay_apart(spark):
    frame = events(spark, *[{"player": f"p{i:02d}"} for i in range(9)]).selectExpr(
        "*", f"{A}L AS ingest_time_ms", "'b' AS batch_id", "CAST(40000 - event_id AS INT) AS idx"
    )
    options = RollupOptions(max_segments=1)
    got = views(labels.capped_rollup(frame, "player", labels.arrival_key(), options))
    assert got == {"p08": 1, "__other__": 8}


def test_batches_of_one_millisecond_are_told_apart(spark):
    frame = events(spark, {"player": "z"}, {"player": "a"}).selectExpr(
        "*", f"{A}L AS ingest_time_ms", "IF(player = 'z', 'b1', 'b2') AS batch_id", "0 AS idx"
    )
    got = labels.tracked_labels(frame, "player", labels.arrival_key(), RollupOptions(max_segments=1))
    assert [r["name"] for r in rows(got)] == ["z"]
