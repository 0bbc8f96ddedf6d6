"""Adapter from the given ``events`` table to playback events and raw batches.

The same integer and string rules are restated in ``duckdb_oracle.py`` for the
side-by-side check, so both engines derive identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.options import DAY_MS
from playtally.session import configure

# Bitrates of the test data, in kbps.
BITRATE_LADDER = (400, 900, 1600, 2500, 3600, 4900)

# Given event type -> playback type for an even and for an odd ``k``.
_TYPE_PAIRS = {
    "view": ("video_start", "startup_complete"),
    "click": ("buffer_start", "buffer_end"),
    "purchase": ("playback_end", "bitrate_change"),
    "error": ("drm_error", "seek"),
    "signup": ("pause", "resume"),
}

EVENTS_PER_BATCH = 50
DEFECT_CYCLE = 20


def given_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _playback_type() -> str:
    cases = [
        f"WHEN '{source}' THEN IF(k % 2 = 0, '{even}', '{odd}')"
        for source, (even, odd) in _TYPE_PAIRS.items()
    ]
    return f"CASE event_type {' '.join(cases)} END"


def _sample(kind: str, value: str, faulty: bool) -> str:
    """A payload of events of one kind; now and then absent or negative."""
    if faulty:
        value = (
            f"CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 97 = 0 THEN -1 ELSE {value} END"
        )
    return f"IF(kind = '{kind}', {value}, NULL)"


def _label(prefix: str, gap: int, n: int) -> str:
    return f"IF(user_id % {gap} = 0, '', concat('{prefix}', user_id % {n}))"


def adapt(given: DataFrame, faulty: bool = True) -> DataFrame:
    """Playback events derived row by row from the given events."""
    ladder = f"array({', '.join(map(str, BITRATE_LADDER))})"
    return (
        given.selectExpr("*", r"CAST(regexp_extract(props, r'(\d+)', 1) AS BIGINT) AS k")
        .selectExpr("*", f"{_playback_type()} AS kind")
        .selectExpr(
            "event_id",
            "kind AS event_type",
            "concat('u', user_id) AS session_id",
            f"{_label('player', 7, 5)} AS player",
            f"{_label('device', 11, 6)} AS device",
            "unix_millis(CAST(ts AS TIMESTAMP)) AS timestamp_ms",
            f"CAST({_sample('startup_complete', 'floor(value * 10D)', faulty)} AS INT) AS startup_time_ms",
            f"CAST({_sample('buffer_end', 'floor(value * 7D)', faulty)} AS INT) AS buffer_duration_ms",
            f"CAST({_sample('bitrate_change', f'{ladder}[CAST(k % 6 AS INT)]', faulty)} AS INT)"
            " AS bitrate_kbps",
            f"CAST({_sample('playback_end', 'floor(value * 1000D)', faulty)} AS BIGINT) AS watch_time_ms",
            "IF(kind = 'drm_error', 'E17', NULL) AS error_code",
        )
    )


def playback_events(
    spark: SparkSession,
    sf_dir: str,
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> DataFrame:
    """Typed playback events; the optional bounds are pushed into the scan."""
    given = given_events(spark, sf_dir)
    if from_ms is not None:
        given = given.where(F.col("ts") >= _ntz(from_ms))
    if to_ms is not None:
        given = given.where(F.col("ts") < _ntz(to_ms + 1))
    return adapt(given)


def _ntz(ms: int) -> Column:
    return F.timestamp_millis(F.lit(ms)).cast("timestamp_ntz")


def wide_labels(events: DataFrame) -> DataFrame:
    """Sessions as players: many distinct labels, for the label cap."""
    return events.withColumn("player", F.col("session_id"))


def _member_text() -> str:
    """JSON text of one event, with the defect its batch calls for.

    Members whose JSON type changes are spliced in as text; NULL drops them.
    """
    quoted = lambda c: f"concat('\"', {c}, '\"')"
    members = {
        "event_type": "CASE WHEN r = 8 AND hit THEN NULL"
        " WHEN (r = 1 AND hit) OR (r = 7 AND idx = 10) THEN '\"bogus\"'"
        f" ELSE {quoted('event_type')} END",
        "session_id": quoted("session_id"),
        "player": "CASE WHEN r = 13 AND hit THEN '5'"
        f" WHEN (r = 3 AND hit) OR (r = 7 AND idx = 3) THEN {quoted(chr(39) + 'x' * 129 + chr(39))}"
        f" ELSE {quoted('player')} END",
        "device": quoted("device"),
        "timestamp": "CASE WHEN r = 12 AND hit THEN NULL"
        f" WHEN r = 2 AND hit THEN {quoted('timestamp_ms')}"
        f" WHEN r = 5 AND hit THEN CAST(timestamp_ms - {8 * DAY_MS} AS STRING)"
        " ELSE CAST(timestamp_ms AS STRING) END",
        "startup_time_ms": "IF(r = 4 AND hit, '600001', CAST(startup_time_ms AS STRING))",
        "buffer_duration_ms": "buffer_duration_ms",
        "bitrate_kbps": "bitrate_kbps",
        "watch_time_ms": "watch_time_ms",
        "error_code": quoted("error_code"),
    }
    pairs = ", ".join(f"concat('\"{name}\":', {value})" for name, value in members.items())
    return f"IF(r = 9 AND hit, '7', concat('{{', concat_ws(',', {pairs}), '}}'))"


def raw_batches(spark: SparkSession, sf_dir: str, shape_defects: bool = False) -> DataFrame:
    """One JSON body per fifty consecutive events, a known share of them bad.

    ``shape_defects`` adds the bodies that only a tightened limit refuses:
    padding (15), deep nesting (16), breadth (17) and too many events (18).
    """
    return batches_of(adapt(given_events(spark, sf_dir), faulty=False), shape_defects)


def batches_of(events: DataFrame, shape_defects: bool = False) -> DataFrame:
    """Serialise typed events into bodies; a batch has at most fifty."""
    per = EVENTS_PER_BATCH
    texts = (
        events.selectExpr(
            "*", f"CAST(event_id % {per} AS INT) AS idx", f"event_id div {per} AS batch_no"
        )
        .selectExpr("*", f"batch_no % {DEFECT_CYCLE} AS r", f"idx = (batch_no * 7) % {per} AS hit")
        .selectExpr("batch_no", "timestamp_ms", "idx", f"{_member_text()} AS text")
    )
    # The group is bounded by construction: fifty ids share a batch number.
    grouped = texts.groupBy("batch_no").agg(
        F.expr("max(timestamp_ms) + 1000 AS ingest_time_ms"),
        F.expr("sort_array(collect_list(struct(idx, text))) AS parts"),
    )
    listed = "concat('[', joined, ']')"
    bodies = {
        6: "concat('[', joined)",
        10: f"concat('{{\"data\":', {listed}, '}}')",
        11: "'[]'",
        14: f"concat('{{\"events\":', {listed}, '}}')",
    }
    if shape_defects:
        noted = lambda note: f"concat('{{\"note\":', {note}, ',\"events\":', {listed}, '}}')"
        bodies |= {
            15: f"concat({listed}, repeat(' ', 70000))",
            16: noted("repeat('[', 39), repeat(']', 39)"),
            17: noted("'[', repeat('0,', 6000), '0]'"),
            18: "concat('[', joined, ',', joined, ']')",
        }
    cases = " ".join(f"WHEN {r} THEN {body}" for r, body in bodies.items())
    return grouped.selectExpr(
        "batch_no", "ingest_time_ms", "array_join(parts.text, ',') AS joined"
    ).selectExpr(
        "CAST(batch_no AS STRING) AS batch_id",
        "ingest_time_ms",
        f"CASE batch_no % {DEFECT_CYCLE} {cases} ELSE {listed} END AS body",
    )
