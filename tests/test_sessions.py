from __future__ import annotations

from playtally.operators.sessions import session_audit
from tests.helpers import A, events, rows


def session(name, *steps, player="p", device="d"):
    return [
        {
            "session_id": name,
            "event_type": kind,
            "timestamp_ms": A + t,
            "player": player,
            "device": device,
            "watch_time_ms": watch,
        }
        for kind, t, watch in steps
    ]


GOOD = (("video_start", 0, None), ("pause", 10, None), ("pause", 10, None), ("playback_end", 500, 500))


def audit(spark, *made, **kw):
    return {r["session_id"]: r for r in rows(session_audit(events(spark, *made), **kw))}


def test_checks(spark):
    made = [
        *session("good", *GOOD),
        *session("unopened", *GOOD[1:]),
        *session("unended", *GOOD[:-1]),
        *session("back", GOOD[0], ("pause", 300, None), ("pause", 200, None), GOOD[-1]),
        *session("watch", *GOOD[:-1], ("playback_end", 500, 400)),
        *session("unwatched", *GOOD[:-1], ("playback_end", 500, None)),
        *session("moved", *GOOD[:2]),
        *session("moved", *GOOD[2:], player="q"),
    ]
    got = audit(spark, *made)
    failed = {
        name: {c for c in r if isinstance(r[c], bool) and not r[c]} - {"well_formed"}
        for name, r in got.items()
    }
    assert failed == {
        "good": set(),
        "unopened": {"starts_ok", "watch_ok"},
        "unended": {"ends_ok", "watch_ok"},
        "back": {"in_order"},
        "watch": {"watch_ok"},
        "unwatched": {"watch_ok"},
        "moved": {"one_player"},
    }
    assert [n for n, r in got.items() if r["well_formed"]] == ["good"]
    assert got["back"]["steps_back"] == 1 and got["good"]["n_events"] == 4


def test_slices_change_nothing(spark):
    made = []
    for i in range(60):
        made += session(f"s{i % 7}", (("video_start", "pause", "playback_end")[i % 3], (i * 37) % 50, i))
    whole = audit(spark, *made)
    for size in (1, 3, 10):
        assert audit(spark, *made, slice_size=size) == whole
