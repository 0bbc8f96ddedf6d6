"""Small inputs for the hand-written cases."""

from __future__ import annotations

import json

from playtally.schema import COUNTERS, PLAYBACK_EVENTS

# Two neighbouring minutes.
A = 1_784_556_180_000
B = A + 60_000

DEFAULTS = {
    "event_id": 0,
    "event_type": "video_start",
    "session_id": "s",
    "player": "",
    "device": "",
    "timestamp_ms": A,
    "startup_time_ms": None,
    "buffer_duration_ms": None,
    "bitrate_kbps": None,
    "watch_time_ms": None,
    "error_code": None,
}


def events(spark, *rows: dict):
    """Typed events; ``event_id`` counts up unless given."""
    filled = [{**DEFAULTS, "event_id": i, **row} for i, row in enumerate(rows)]
    return spark.createDataFrame(
        [tuple(r[n] for n in PLAYBACK_EVENTS.names) for r in filled], PLAYBACK_EVENTS
    )


def batch(spark, *bodies, ingest_time_ms: int = A + 1000):
    """Raw batches from texts or from objects to serialise."""
    texts = [b if isinstance(b, str) else json.dumps(b) for b in bodies]
    rows = [(str(i), ingest_time_ms, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "batch_id string, ingest_time_ms bigint, body string")


def event(**members) -> dict:
    return {"event_type": "video_start", "timestamp": A, **members}


def rows(frame) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.collect()]


def counters(frame) -> list[tuple]:
    return sorted(tuple(r[c] for c in COUNTERS) for r in frame.collect())


def one(frame) -> dict:
    (row,) = rows(frame)
    return row
