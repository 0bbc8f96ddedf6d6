from __future__ import annotations

import pytest

from playtally.operators import rollups, snapshot
from playtally.options import RollupOptions
from playtally.plans.reads import PlaybackMetrics
from playtally.sources import raw
from playtally.sources.store import RollupStore
from tests.helpers import A, batch, counters, event, events, one, rows

DAY = 86_400_000


def epoch(spark, *made):
    return rollups.multi_rollup(events(spark, *made))


def test_empty_store(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    assert store.published() == (-1, -1)
    assert store.minutes().count() == 0
    assert one(PlaybackMetrics.from_store(store).overall())["minutes_tracked"] == 0
    with pytest.raises(ValueError, match="no snapshot"):
        store.read_snapshot()


def test_partials_merge_and_an_epoch_written_twice_counts_once(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    first = epoch(spark, {"player": "p"}, {"timestamp_ms": A + DAY})
    store.write_epoch(first, 0)
    store.write_epoch(epoch(spark, {"player": "p"}, {}), 1)
    store.write_epoch(first, 0)
    assert {r["minute_ms"]: r["total_events"] for r in rows(store.minutes())} == {A: 3, A + DAY: 1}
    assert {r["name"]: r["total_events"] for r in rows(store.segments("player"))} == {"p": 2}
    metrics = PlaybackMetrics.from_store(store, active_sessions=3)
    assert one(metrics.overall())["total_events"] == 4
    assert one(metrics.status())["active_sessions"] == 3
    assert one(metrics.minute(A + DAY))["total_views"] == 1


def test_an_epoch_that_lost_days_leaves_none_of_them(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    store.write_epoch(epoch(spark, {}, {"timestamp_ms": A + DAY}), 0)
    store.write_epoch(epoch(spark, {}), 0)
    assert [r["minute_ms"] for r in rows(store.minutes())] == [A]


def test_range_reads_only_its_days(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    store.write_epoch(epoch(spark, *[{"timestamp_ms": A + i * DAY, "player": "p"} for i in range(4)]), 0)
    got = store.minutes(A + DAY, A + DAY + 5)
    assert [r["minute_ms"] for r in rows(got)] == [A + DAY]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2026-07-21" in plan
    assert "GreaterThanOrEqual(minute_ms" in plan
    assert len(got.inputFiles()) >= 1


def test_compaction_keeps_results(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    for i in range(4):
        store.write_epoch(epoch(spark, {"player": f"p{i % 2}"}, {"timestamp_ms": A + i * 60_000}), i)
    before = counters(store.minutes()), counters(store.segments("player"))
    assert store.compact(2) == 0
    assert store.published() == (0, 2)
    assert (counters(store.minutes()), counters(store.segments("player"))) == before
    assert store.compact(2) == 0
    assert store.compact(3) == 1
    assert (counters(store.minutes()), counters(store.segments("player"))) == before
    assert counters(store.read_snapshot().where("grain = 'minute'")) == before[0]


def test_vacuum_keeps_what_the_former_snapshot_needs(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    for i in range(5):
        store.write_epoch(epoch(spark, {"timestamp_ms": A + i * 60_000}), i)
    store.compact(1)
    assert store.vacuum() == 0
    store.compact(2)
    store.compact(3)
    before = counters(store.minutes())
    assert store.vacuum() == 4
    assert sorted(p.name for p in (tmp_path / "partials").iterdir()) == ["epoch_id=3", "epoch_id=4"]
    assert sorted(p.name for p in (tmp_path / "snapshots").iterdir()) == [
        "snapshot_id=1",
        "snapshot_id=2",
    ]
    assert counters(store.minutes()) == before


def test_an_unpublished_snapshot_is_not_seen(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    store.write_snapshot(epoch(spark, {}), 5)
    # What a writer leaves that stopped before publishing.
    epoch(spark, {}, {}, {}).selectExpr("*", "'-' AS day").write.partitionBy("day").parquet(
        f"{tmp_path}/snapshots/snapshot_id=6"
    )
    assert one(PlaybackMetrics.from_store(store).overall())["total_events"] == 1
    with pytest.raises(ValueError, match="not newer"):
        store.write_snapshot(epoch(spark, {}), 5)


def test_bodies_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"event_type":\n"pause"}]')
    row = one(raw.read_bodies(spark, str(tmp_path), ingest_time_ms=A))
    assert row == {"batch_id": "a.json", "ingest_time_ms": A, "body": '[{"event_type":\n"pause"}]'}
    assert one(raw.read_bodies(spark, str(tmp_path)))["ingest_time_ms"] > A - 10 * 365 * DAY


def test_batches_from_parquet(spark, tmp_path):
    made = batch(spark, [event()], "[]")
    made.write.parquet(str(tmp_path / "raw"))
    assert raw.read_batches(spark, str(tmp_path / "raw")).count() == 2


def test_spool_is_ordered_by_number(spark, tmp_path):
    for name in ("batch-10.json", "batch-9.json", "batch-00000008.json"):
        (tmp_path / name).write_text("[]")
    (tmp_path / "batch-11.json").write_text("[")
    for name in ("batch-.json", "batch-x.json", "batch-1.json.tmp", "other-1.json", "batch-99999999999999999999999.json"):
        (tmp_path / name).write_text("[]")
    got = rows(raw.backfill(raw.read_spool(spark, str(tmp_path))).orderBy("spool_index"))
    assert [(int(r["spool_index"]), r["usable"]) for r in got] == [
        (8, True),
        (9, True),
        (10, True),
        (11, False),
    ]


def test_newest_batches_stay(spark):
    frame = spark.range(30).selectExpr("id AS spool_index", "concat('f', id) AS file_name", "'' AS body")
    kept = lambda n: sorted(r["spool_index"] for r in rows(raw.retain_newest(frame, "spool_index", n)))
    assert kept(3) == [27, 28, 29]
    assert kept(0) == [29]
    assert kept(1000) == list(range(30))


def test_files_that_share_a_number_are_counted_one_by_one(spark):
    names = [f"batch-{n}.json" for n in ("3", "03", "003", "2")]
    spool = spark.createDataFrame([(n, "[1]" if n != "batch-2.json" else "[") for n in names], "file_name string, body string")
    numbered = raw.backfill(spool)
    kept = rows(raw.retain_newest(numbered, "spool_index", 1))
    assert [r["file_name"] for r in kept] == ["batch-3.json"]
    assert one(raw.backlog_counts(numbered, 1)) == {"numbered": 4, "evicted": 3, "unusable": 1}
    replay = [r["batch_id"][20:] for r in rows(raw.replayed(numbered, A).orderBy("batch_id"))]
    assert replay == ["-batch-003.json", "-batch-03.json", "-batch-3.json"]


def labelled(spark, *names):
    return snapshot.to_documents(epoch(spark, *[{"player": n, "device": "d"} for n in names]))


def players(store):
    return {r["name"]: r["total_events"] for r in rows(store.segments("player"))}


def test_restored_labels_beyond_the_cap_are_folded_and_counted(spark, tmp_path):
    store, cap = RollupStore(spark, str(tmp_path)), RollupOptions(max_segments=4)
    store.restore(labelled(spark, *(f"p{i:02d}" for i in range(30)), "p07"), cap)
    assert players(store) == {"p00": 1, "p01": 1, "p02": 1, "p03": 1, "__other__": 27}
    assert one(store.ledger())["segment_overflows"] == 26
    # Tracked labels keep their rows, and the shared row is restored into itself and is no fold.
    store.restore(labelled(spark, "p02", "p99", "__other__"), cap)
    assert players(store) == {"p00": 1, "p01": 1, "p02": 2, "p03": 1, "__other__": 29}
    assert one(store.ledger())["segment_overflows"] == 27
    assert one(PlaybackMetrics.from_store(store).overall())["total_events"] == 34


def test_restore_after_live_epochs_takes_what_is_free(spark, tmp_path):
    store, cap = RollupStore(spark, str(tmp_path)), RollupOptions(max_segments=3)
    store.write_epoch(epoch(spark, {"player": "z"}, {"player": "y"}), 0)
    store.restore(labelled(spark, "b", "a", "y"), cap)
    assert players(store) == {"z": 1, "y": 2, "a": 1, "__other__": 1}
    assert store.published()[1] == -1
    store.compact(0)
    assert players(store) == {"z": 1, "y": 2, "a": 1, "__other__": 1}
    assert one(store.ledger())["segment_overflows"] == 1


def test_a_store_with_more_labels_shows_the_first(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    store.write_epoch(epoch(spark, *[{"player": p} for p in ("a", "b", "c", "c", "__other__")]), 0)
    read = lambda n: {
        r["name"]: r["total_events"]
        for r in rows(PlaybackMetrics.from_store(store, options=RollupOptions(max_segments=n)).by_player())
    }
    assert read(1) == {"a": 1, "__other__": 4}
    assert read(3) == {"a": 1, "b": 1, "c": 2, "__other__": 1}
    assert read(1000) == read(3)
    (document,) = rows(PlaybackMetrics.from_store(store, options=RollupOptions(max_segments=1)).players_document())
    assert '"name":"b"' not in str(document)


def test_compaction_writes_touched_days_only(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    store.write_epoch(epoch(spark, *[{"timestamp_ms": A + i * DAY, "player": "p"} for i in range(5)]), 0)
    store.compact(0)
    store.write_epoch(epoch(spark, {"timestamp_ms": A + DAY}, {"timestamp_ms": A + DAY + 60_000}), 1)
    before = counters(store.minutes())
    store.compact(1)
    days = lambda n: sorted(p.name for p in (tmp_path / f"snapshots/snapshot_id={n}").glob("day=*"))
    assert len(days(0)) == 6 and days(1) == ["day=2026-07-21"]
    assert counters(store.minutes()) == before
    assert counters(store.read_snapshot().where("grain = 'minute'")) == before
    # An epoch without rows is published all the same and rewrites nothing.
    store.write_epoch(epoch(spark).limit(0), 2)
    store.compact(2)
    assert store.published() == (2, 2) and not (tmp_path / "snapshots/snapshot_id=2").exists()
    # Of the replaced snapshot the days in use stay.
    store.compact(3)
    store.vacuum()
    assert len(days(0)) == 5 and counters(store.minutes()) == before
    assert players(store) == {"p": 5}


def test_latest_buckets_open_the_newest_days(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    store.write_epoch(
        epoch(spark, *[{"timestamp_ms": A + i * DAY + j * 60_000} for i in range(8) for j in range(4)]), 0
    )
    store.compact(0)
    metrics = PlaybackMetrics.from_store(store)
    opened = lambda frame: {f.rsplit("day=", 1)[1][:10] for f in frame.inputFiles()}
    for n, wanted in ((1, 1), (4, 1), (5, 2), (13, 4), (32, 8), (100, 8)):
        want = sorted(r["minute_ms"] for r in rows(store.minutes()))[-n:]
        assert [r["minute_ms"] for r in rows(metrics.live(n))] == want
        assert len(opened(store.recent(n))) == wanted
    # Later partials: an older day gets a bucket, a newer one comes up.
    store.write_epoch(epoch(spark, {"timestamp_ms": A + 2 * DAY + 9 * 60_000}, {"timestamp_ms": A + 9 * DAY}), 1)
    want = sorted(r["minute_ms"] for r in rows(store.minutes()))
    for n in (1, 2, 6, 21, 22, 40):
        assert [r["minute_ms"] for r in rows(metrics.live(n))] == want[-n:]
    assert len(opened(store.recent(2))) == 2
    assert one(metrics.kpi_panel())["total_events"] == 15
    assert RollupStore(spark, str(tmp_path / "none")).recent(5).count() == 0
