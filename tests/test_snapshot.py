from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from playtally.functions.counters import as_metrics
from playtally.operators import rollups, snapshot
from playtally.schema import COUNTERS
from tests.helpers import A, counters, events, one, rows


def entry(**members):
    return {**{c: 0 for c in COUNTERS}, "total_events": 1, **members}


def minute(**members):
    return {"y": 2026, "mo": 7, "d": 20, "h": 14, "mi": 3, "m": entry(), **members}


def document(**members):
    return {"version": 2, "minutes": [], "players": [], "devices": [], **members}


def check(spark, *docs):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in docs]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string")
    return snapshot.check_documents(frame)


def reasons(spark, *docs):
    return [r["reason"] for r in rows(check(spark, *docs).orderBy("doc_id"))]


def without(d, key):
    return {k: v for k, v in d.items() if k != key}


def test_round_trip(spark):
    made = rollups.multi_rollup(
        events(
            spark,
            {"player": "Exo", "device": "TV"},
            {"player": "Exo"},
            {"player": 'A"V\\', "timestamp_ms": A + 86_400_000},
            {"event_type": "startup_complete", "startup_time_ms": 2000},
        )
    )
    docs = snapshot.to_documents(made, label_buckets=1)
    checked = snapshot.check_documents(docs)
    assert {r["reason"] for r in rows(checked)} == {None}
    assert sorted(r["doc_id"] for r in rows(docs)) == [
        "devices-0-0",
        "minutes-2026-07-20",
        "minutes-2026-07-21",
        "players-0-0",
    ]
    back = snapshot.document_rows(checked)
    order = ("grain", "minute_ms", "name", *COUNTERS)
    key = lambda f: sorted(map(repr, (tuple(r[c] for c in order) for r in f.collect())))
    assert key(back) == key(made)
    body = json.loads(docs.where("doc_id = 'minutes-2026-07-20'").first()["body"])
    assert body["version"] == 2 and body["players"] == [] and body["devices"] == []
    assert set(body["minutes"][0]) == {"y", "mo", "d", "h", "mi", "m"}
    assert set(body["minutes"][0]["m"]) == set(COUNTERS)


def test_documents_that_are_refused(spark):
    cases = {
        "not valid JSON": "{",
        "not an object": "[]",
        "version is no integer": [{}, document(version="2"), document(version=2.0)],
        "is not supported": [document(version=0), document(version=3)],
        "minutes is not a list": document(minutes={}),
        "players is not a list": document(players=5),
        "minutes holds an entry that is not an object": [
            document(minutes=[5]),
            document(minutes=[None, minute()]),
        ],
        "minute entry has no m": document(minutes=[without(minute(), "m")]),
        "metrics entry is not an object": document(minutes=[minute(m=5)]),
        "minute field y": [document(minutes=[minute(y=1969)]), document(minutes=[minute(y=10000)])],
        "minute field mo": [document(minutes=[minute(mo=0)]), document(minutes=[minute(mo=13)])],
        "minute field d": document(minutes=[minute(), minute(d=32)]),
        "minute field h": document(minutes=[minute(h="1")]),
        "minute field mi": [
            document(minutes=[minute(mi=60)]),
            document(minutes=[without(minute(), "mi")]),
            document(minutes=[minute(mi=None)]),
        ],
        "no calendar day": [document(minutes=[minute(mo=2, d=30)]), document(minutes=[minute(y=2025, mo=2, d=29)])],
        "counter total_views": [
            document(minutes=[minute(m=without(entry(), "total_views"))]),
            document(minutes=[minute(m=entry(total_views=-1))]),
            document(minutes=[minute(m=entry(total_views="1"))]),
            document(minutes=[minute(m=entry(total_views=1.0))]),
            document(minutes=[minute(m=entry(total_views=None)), minute()]),
            document(minutes=[minute(m=entry(total_views=2**63))]),
            document(version=1, players=[{"name": "p", "m": without(entry(), "total_views")}]),
        ],
        "counter buffer_samples": document(devices=[{"name": "d", "m": without(entry(), "buffer_samples")}]),
        "players entry has no string name": [
            document(players=[{"m": entry()}]),
            document(players=[{"name": 5, "m": entry()}]),
            document(players=[{"name": None, "m": entry()}]),
        ],
        "devices entry has no m": document(devices=[{"name": "d"}]),
        "devices holds an entry that is not an object": document(devices=["d"]),
    }
    flat = [(want, d) for want, ds in cases.items() for d in (ds if isinstance(ds, list) and ds and want != "not an object" else [ds])]
    got = reasons(spark, *[d for _, d in flat])
    for (want, doc), reason in zip(flat, got):
        assert reason is not None and want in reason, (want, reason, doc)


def test_documents_that_are_sound(spark):
    sound = [
        {"version": 2},
        document(),
        document(minutes=[minute(y=2024, mo=2, d=29), minute(y=9999, mo=12, d=31, h=23, mi=59)]),
        document(players=[{"name": "", "m": entry()}], note={"x": [None]}),
        document(minutes=[minute(extra=1)]),
        document(version=1, minutes=[minute(m=without(entry(), "buffer_samples"))]),
        document(version=1, minutes=[minute()]),
        document(minutes=[minute(m=entry(total_events=2**63 - 1))]),
    ]
    assert reasons(spark, *sound) == [None] * len(sound)
    assert snapshot.document_rows(check(spark, *sound)).count() == 7


def test_all_or_nothing(spark):
    checked = check(spark, document(minutes=[minute()]), document(version=9))
    with pytest.raises(ValueError, match="version 9 is not supported"):
        snapshot.require_sound(checked)
    snapshot.require_sound(check(spark, document()))
    half = document(minutes=[minute(), minute(d=40)])
    assert snapshot.document_rows(check(spark, half)).count() == 0


def test_version_one_has_no_stall_samples(spark):
    stalls = entry(buffer_count=1, buffer_duration_ms_sum=900)
    old = document(version=1, minutes=[minute(m=without(stalls, "buffer_samples"))])
    row = one(as_metrics(snapshot.platform_totals(snapshot.document_rows(check(spark, old)))))
    assert (row["buffer_count"], row["buffer_samples"], row["buffer_avg_ms"]) == (1, 0, 0.0)


def test_restore_adds(spark):
    live = rollups.multi_rollup(events(spark, {"player": "p"}, {"player": "q"}))
    old = snapshot.document_rows(
        check(
            spark,
            document(
                minutes=[minute(m=entry(total_events=3)), minute(mi=9)],
                players=[{"name": "p", "m": entry(total_events=5)}],
            ),
        )
    )
    got = {(r["grain"], r["minute_ms"], r["name"]): r["total_events"] for r in rows(snapshot.restore(live, old))}
    assert got == {
        ("minute", A, None): 5,
        ("minute", A + 360_000, None): 1,
        ("player", None, "p"): 6,
        ("player", None, "q"): 1,
    }
    # Restored segments do not add to the platform total, restored minutes do.
    assert one(snapshot.platform_totals(snapshot.restore(live, old)))["total_events"] == 6


def test_restore_twice_is_double(spark):
    rows_ = rollups.multi_rollup(events(spark, {"player": "p"}, {"event_type": "drm_error"}))
    twice = snapshot.restore(rows_, rows_)
    assert counters(twice) == [tuple(2 * v for v in c) for c in counters(rows_)]


def test_one_unsound_document_refuses_its_snapshot(spark):
    good, bad = document(minutes=[minute()]), document(version=9)
    assert snapshot.document_rows(check(spark, good, bad)).count() == 0
    assert snapshot.document_rows(check(spark, good, good)).count() == 2
    units = [("s1", good), ("s1", bad), ("s2", good), (None, good)]
    named = spark.createDataFrame([(u, json.dumps(d)) for u, d in units], "snapshot_id string, body string")
    assert snapshot.document_rows(snapshot.check_documents(named)).count() == 2


def test_documents_are_checked_once(spark):
    """Finding refused snapshots and giving the rows of the others takes one pass over the documents."""
    seen = spark.sparkContext.accumulator(0)

    def counted(body):
        seen.add(1)
        return body

    made = events(spark, *[{"timestamp_ms": A + i * 86_400_000, "player": f"p{i}"} for i in range(6)])
    documents = snapshot.to_documents(rollups.multi_rollup(made)).withColumn("snapshot_id", F.monotonically_increasing_id() % 3)
    whole = documents.collect()
    kept = spark.createDataFrame(whole, documents.schema).coalesce(1)
    damaged = F.when(F.col("snapshot_id") == 1, F.lit("[")).otherwise(F.col("body"))
    frame = kept.withColumn("body", F.udf(counted)(damaged))
    found = snapshot.document_rows(snapshot.check_documents(frame)).collect()
    assert found and seen.value == len(whole)
    want = snapshot.document_rows(snapshot.check_documents(kept.where("snapshot_id <> 1"))).collect()
    assert sorted(map(str, found)) == sorted(map(str, want))
