"""Random batches against a plain walk over the parsed JSON."""

from __future__ import annotations

import json
import random

from playtally.operators.validate import accepted_events, verdicts, with_verdict
from playtally.options import DAY_MS, IngestLimits
from playtally.schema import EVENT_TYPES
from tests.helpers import A, batch, rows

NOW = A + 5000
LIMITS = IngestLimits(max_events_per_batch=6)


def is_int(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def fault_of(e):
    if not isinstance(e, dict):
        return "not_an_object"
    kind = e.get("event_type")
    if not isinstance(kind, str) or kind == "":
        return "missing_event_type"
    if kind not in EVENT_TYPES:
        return "unknown_event_type"
    if "timestamp" in e:
        if not is_int(e["timestamp"]):
            return "non_integer_timestamp"
        if not NOW - 7 * DAY_MS <= e["timestamp"] <= NOW + 300_000:
            return "timestamp_outside_window"
    for label in ("player", "device"):
        if isinstance(e.get(label), str) and len(e[label].encode()) > 128:
            return f"{label}_label_too_long"
    for field, largest in LIMITS.numeric_ranges:
        if field in e:
            if not is_int(e[field]):
                return f"non_integer_{field}"
            if not 0 <= e[field] <= largest:
                return f"{field}_out_of_range"
    return None


def verdict_of(doc):
    if isinstance(doc, list):
        found = doc
    elif isinstance(doc, dict) and "events" in doc:
        found = doc["events"]
    else:
        return None, "no_events"
    if not isinstance(found, list):
        return None, "events_not_a_list"
    if not found:
        return None, "no_event"
    if len(found) > LIMITS.max_events_per_batch:
        return None, "too_many_events"
    for i, e in enumerate(found):
        reason = fault_of(e)
        if reason:
            return i, reason
    return None, None


def random_event(rng):
    if rng.random() < 0.02:
        return rng.choice([5, None, "x", [], [{}], True])
    odd = [None, "5", 1.5, True, [], {}, -1, 2**31, 2**40, ""]
    e = {"event_type": rng.choice(EVENT_TYPES), "session_id": f"s{rng.randrange(9)}"}
    for label in ("player", "device"):
        if rng.random() < 0.7:
            e[label] = rng.choice(["", "ExoPlayer", "null", "é" * rng.choice([3, 64, 65]), 'q"\\[{,'])
    if rng.random() < 0.8:
        e["timestamp"] = NOW - rng.randrange(8 * DAY_MS if rng.random() < 0.1 else DAY_MS)
    for field, largest in LIMITS.numeric_ranges:
        if rng.random() < 0.3:
            e[field] = rng.randrange(largest + 1)
    if rng.random() < 0.15:
        e[rng.choice([*e, "timestamp", "bitrate_kbps", "watch_time_ms", "note"])] = rng.choice(odd)
    if rng.random() < 0.05:
        e["event_type"] = rng.choice(["bogus", "", "PAUSE"])
    if rng.random() < 0.1:
        e[rng.choice(["seek_to_ms", "a b", "x>>", "timestamp: BIGINT"])] = rng.choice([7, "t", 1.5, [1]])
    return e


def random_body(rng):
    found = [random_event(rng) for _ in range(rng.randrange(8))]
    roll = rng.random()
    if roll < 0.7:
        return found
    if roll < 0.9:
        return {"events": found, **({"v": None} if rng.random() < 0.3 else {})}
    return rng.choice([{"events": 5}, {"data": found}, 5, None, "x", {"events": {"0": found}}, {}])


def test_same_verdicts_and_events(spark):
    rng = random.Random(20)
    docs = [random_body(rng) for _ in range(1500)]
    frame = batch(spark, *[json.dumps(d, ensure_ascii=rng.random() < 0.5) for d in docs], ingest_time_ms=NOW)
    got = {int(r["batch_id"]): r for r in rows(verdicts(frame, LIMITS))}
    want = {i: verdict_of(d) for i, d in enumerate(docs)}
    wrong = {
        i: (docs[i], w, got[i])
        for i, w in want.items()
        if (got[i]["first_idx"], got[i]["reason"]) != w
    }
    assert not wrong, list(wrong.values())[:3]
    reasons = {w[1] for w in want.values()}
    assert None in reasons and len(reasons) > 15

    flat = {}
    for r in rows(accepted_events(with_verdict(frame, LIMITS))):
        flat[int(r["batch_id"]), r["idx"]] = r
    accepted = [(i, d) for i, d in enumerate(docs) if want[i] == (None, None)]
    total = 0
    for i, doc in accepted:
        for j, e in enumerate(doc if isinstance(doc, list) else doc["events"]):
            total += 1
            r = flat[i, j]
            assert r["event_type"] == e["event_type"]
            assert r["timestamp_ms"] == e.get("timestamp", NOW)
            for name in ("session_id", "player", "device"):
                assert r[name] == (e[name] if isinstance(e.get(name), str) else "")
            for field, _ in LIMITS.numeric_ranges:
                assert r[field] == e.get(field)
    assert total == len(flat) > 500
