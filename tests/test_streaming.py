from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from playtally.operators import gauge, labels, rollups, snapshot
from playtally.operators.validate import accepted_events, with_verdict
from playtally.options import IngestLimits, RollupOptions
from playtally.plans.reads import PlaybackMetrics
from playtally.schema import COUNTERS, PLAYBACK_EVENTS
from playtally.sources import raw
from playtally.sources.store import RollupStore
from playtally.streaming.ingest import (
    EpochWriter,
    LabelSlots,
    SessionGauge,
    drop_resent,
    minute_windows,
    start_ingest,
)
from tests.helpers import A, batch, event, events, one, rows


def bodies(n, seed=1):
    rng = random.Random(seed)
    kinds = ["video_start", "playback_end", "drm_error", "startup_complete"]
    made = []
    for i in range(n):
        if i % 5 == 4:
            made.append("[")
            continue
        made.append(
            json.dumps(
                [
                    event(
                        event_type=rng.choice(kinds),
                        timestamp=A + i * 60_000 + rng.randrange(60_000),
                        player=f"p{rng.randrange(9)}",
                        device=f"d{i % 3}",
                        startup_time_ms=rng.randrange(900),
                    )
                    for _ in range(6)
                ]
            )
        )
    return made


def spool(spark, path, texts, first=0):
    for i, text in enumerate(texts, first):
        frame = spark.createDataFrame(
            [(f"{i:04d}", A + i * 60_000, text)],
            "batch_id string, ingest_time_ms bigint, body string",
        )
        frame.coalesce(1).write.mode("append").parquet(path)


def keyed(frame, *keys):
    return {tuple(r[k] for k in keys): tuple(r[c] for c in COUNTERS) for r in frame.collect()}


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    source, root, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    options = RollupOptions(max_segments=4)
    texts = bodies(12)
    for start in (0, 6):
        spool(spark, source, texts[start : start + 6], start)
        query = start_ingest(
            raw.stream_batches(spark, source, max_files=2),
            root,
            check,
            options=options,
            compact_every=4,
        )
        query.awaitTermination()
        assert query.exception() is None
    seen = [p["observedMetrics"]["ingest"] for p in map(json.loads, (p.json for p in query.recentProgress)) if p.get("observedMetrics")]
    assert sum(s["batches"] for s in seen) == 6
    assert sum(s["rejected_batches"] for s in seen) == 1

    store = RollupStore(spark, root)
    judged = with_verdict(raw.read_batches(spark, source))
    flat = accepted_events(judged).persist()
    assert keyed(store.minutes(), "minute_ms") == keyed(rollups.by_minute(flat), "minute_ms")
    for dimension in rollups.DIMENSIONS:
        want = labels.capped_rollup(flat, dimension, labels.arrival_key(), options)
        assert keyed(store.segments(dimension), "name") == keyed(want, "name")
    # Nothing is left unpublished at a clean end.
    assert store.published() == (store.published()[0], store.last_epoch())
    assert store._later(store._current()).isEmpty()
    ledger = one(store.ledger())
    assert (ledger["batches"], ledger["rejected_batches"], ledger["events"]) == (12, 2, flat.count())
    folded = sum(one(labels.overflow_count(flat, d, labels.arrival_key(), options))["overflows"] for d in rollups.DIMENSIONS)
    assert ledger["segment_overflows"] == folded > 0

    in_time = gauge.active_sessions(flat, ("timestamp_ms", *gauge.ARRIVAL))
    want = one(gauge.current_sessions(in_time))
    level = SessionGauge(spark, f"{root}/session_gauge").current()
    assert level == want["active_sessions"]
    status = one(PlaybackMetrics.from_store(store, level).status())
    assert status["total_events"] == flat.count()


def test_running_an_epoch_again_changes_nothing(spark, tmp_path):
    slots = LabelSlots(spark, str(tmp_path / "slots"), RollupOptions(max_segments=2))
    sessions = SessionGauge(spark, str(tmp_path / "gauge"))
    flat = lambda *es: accepted_events(with_verdict(batch(spark, list(es))))
    first = flat(event(player="a"), event(player="b", event_type="playback_end"), event(player="c"))
    second = flat(event(player="c"), event(player="a"), event(player=""))
    names = lambda f: [r["player"] for r in rows(f.orderBy("idx"))]
    for _ in range(2):
        assert names(slots.assign(first, 0)) == ["a", "b", "__other__"]
        sessions.advance(first, 0)
    for _ in range(2):
        assert names(slots.assign(second, 1)) == ["__other__", "a", ""]
        sessions.advance(second, 1)
    assert sessions.current() == 4
    assert sessions.current(before_epoch=1) == 1


def test_gauge_floor_carries_over_epochs(spark, tmp_path):
    sessions = SessionGauge(spark, str(tmp_path / "gauge"))
    ends = accepted_events(with_verdict(batch(spark, [event(event_type="playback_end")] * 3)))
    starts = accepted_events(with_verdict(batch(spark, [event()] * 2)))
    sessions.advance(starts, 0)
    sessions.advance(ends, 1)
    assert sessions.current() == 0
    sessions.advance(starts, 2)
    assert sessions.current() == 2


def test_event_time_windows(spark, tmp_path):
    made = events(spark, {}, {"timestamp_ms": A + 30_000}, {"timestamp_ms": A + 61_000, "event_type": "drm_error"})
    made.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(PLAYBACK_EVENTS).parquet(str(tmp_path / "events"))
    query = (
        minute_windows(stream)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("minute_windows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert keyed(spark.table("minute_windows"), "minute_ms") == keyed(rollups.by_minute(made), "minute_ms")


def test_resent_batches(spark, tmp_path):
    made = batch(spark, [event()], [event(), event()])
    twice = made.unionByName(made)
    assert accepted_events(with_verdict(twice)).count() == 6
    assert accepted_events(with_verdict(drop_resent(twice))).count() == 3
    twice.coalesce(1).write.parquet(str(tmp_path / "raw"))
    stream = drop_resent(raw.stream_batches(spark, str(tmp_path / "raw")))
    query = (
        stream.writeStream.format("memory")
        .queryName("resent")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert spark.table("resent").count() == 2


def test_kafka_columns(spark):
    frame = spark.range(1).select(
        F.lit("t").alias("topic"),
        F.lit(3).alias("partition"),
        F.lit(9).cast("bigint").alias("offset"),
        F.timestamp_millis(F.lit(A)).alias("timestamp"),
        F.lit("[]").cast("binary").alias("value"),
    )
    assert one(raw.kafka_batches(frame)) == {"batch_id": "t-3-9", "ingest_time_ms": A, "body": "[]"}


def test_restored_labels_keep_their_slots_in_the_stream(spark, tmp_path):
    source, root, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    store = RollupStore(spark, root)
    old = rollups.multi_rollup(events(spark, {"player": "old1"}, {"player": "old2"}))
    store.restore(snapshot.to_documents(old, label_buckets=1))
    spool(spark, source, [json.dumps([event(player=p) for p in ("n1", "n2", "old1")])])
    query = start_ingest(
        raw.stream_batches(spark, source), root, check, options=RollupOptions(max_segments=2)
    )
    query.awaitTermination()
    assert query.exception() is None
    got = {r["name"]: r["total_events"] for r in rows(store.segments("player"))}
    assert got == {"old1": 2, "old2": 1, "__other__": 2}


def test_a_refused_restore_leaves_the_history(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    documents = snapshot.to_documents(rollups.multi_rollup(events(spark, {"player": "p"})), label_buckets=1)
    store.restore(documents)
    damaged = documents.withColumn("body", F.replace("body", F.lit('"h":'), F.lit('"x":')))
    with pytest.raises(ValueError, match="refused"):
        store.restore(documents.unionByName(damaged))
    huge = documents.withColumn("body", F.regexp_replace("body", r'"total_views":\d+', f'"total_views":{2**63 - 1}'))
    with pytest.raises(Exception, match="OVERFLOW"):
        store.restore(huge)
    assert {r["total_events"] for r in rows(store.segments("player"))} == {1}
    store.restore(documents)
    assert {r["total_events"] for r in rows(store.segments("player"))} == {2}


def test_an_epoch_run_again_leaves_one_ledger_and_quarantine(spark, tmp_path):
    writer = EpochWriter(spark, str(tmp_path), RollupOptions(max_segments=1))
    limits = IngestLimits(require_event_type=False, max_bitrate_kbps=2**40)
    first = batch(
        spark,
        [event(player="a"), event(player="b"), {"player": "c", "timestamp": A}, event(player="__other__")],
        "[",
        [event(bitrate_kbps=2**35, event_type="bitrate_change")],
    )
    for _ in range(2):
        writer.write(with_verdict(first, limits), 0)
    writer.write(with_verdict(batch(spark, [event(player="b")])), 1)
    want = {
        "batches": 4,
        "accepted_batches": 3,
        "rejected_batches": 1,
        "unparseable_batches": 1,
        "events": 5,
        "parse_failures": 1,
        "process_errors": 1,
        "segment_overflows": 2,
    }
    assert one(writer.store.ledger()) == want
    refused = rows(writer.store.quarantine().orderBy("batch_id", "idx"))
    assert [(r["batch_id"], r["idx"], r["reason"], r["epoch_id"]) for r in refused] == [
        ("0", 2, "unknown_event_type", 0),
        ("1", None, "not_json", 0),
    ]
    assert refused[1]["raw"] == "[" and json.loads(refused[0]["raw"])["player"] == "c"
    # Published or not, the counters are the same; vacuum drops what is summed up.
    for epoch in (0, 1, 2):
        writer.store.compact(epoch)
        writer.store.vacuum()
        assert one(writer.store.ledger()) == want
    assert not list((tmp_path / "ledger").glob("epoch_id=0*"))


def test_bodies_are_judged_once_an_epoch(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(body):
        seen.add(1)
        return body

    source = batch(spark, *([event(player=f"p{i}")] for i in range(10))).withColumn("body", F.udf(counted)("body").alias("body"))
    source = source.coalesce(1)
    EpochWriter(spark, str(tmp_path)).write(with_verdict(source), 0)
    assert seen.value == 10


def test_a_stopped_stream_publishes_its_partials(spark, tmp_path):
    source, root, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spool(spark, source, bodies(3))
    query = start_ingest(raw.stream_batches(spark, source), root, check, interval="0 seconds")
    query.processAllAvailable()
    store = RollupStore(spark, root)
    assert store.published() == (-1, -1)
    query.stop()
    assert store.published() == (0, store.last_epoch()) and store.last_epoch() >= 0
    assert store._later(store._current()).isEmpty()
    query.stop()
    assert store.published()[0] == 0


def test_a_restore_between_two_runs_of_the_stream(spark, tmp_path):
    """Restored names take the free slots; live labels that come later are folded."""
    source, root, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    options = RollupOptions(max_segments=3)
    store = RollupStore(spark, root)
    run = lambda: start_ingest(raw.stream_batches(spark, source), root, check, options=options, compact_every=0)
    spool(spark, source, [json.dumps([event(player="live1"), event(player="live2")])])
    run().awaitTermination()
    old = rollups.multi_rollup(events(spark, *[{"player": f"old{i}"} for i in range(30)]))
    store.restore(snapshot.to_documents(old), options)
    spool(spark, source, [json.dumps([event(player=p) for p in ("new", "old0", "old1", "live1")])], 1)
    query = run()
    query.awaitTermination()
    assert query.exception() is None
    got = {r["name"]: r["total_events"] for r in rows(store.segments("player"))}
    assert got == {"live1": 2, "live2": 1, "old0": 2, "__other__": 31}
    assert one(store.ledger())["segment_overflows"] == 31
