"""Permissive reading of events for callers that skip batch validation.

Whatever can be used of an event is kept. An element without a known event
type is no event: it is counted and dropped, and the rest goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtally.functions.members import integer, is_text, member, text
from playtally.functions.minutes import MAX_TIMESTAMP_MS, MIN_TIMESTAMP_MS
from playtally.operators.validate import from_list_or_envelope, parse_whole
from playtally.schema import EVENT_TYPES


def parse_batches(batches: DataFrame) -> DataFrame:
    """One row per element of every body that holds a list; ``parsed`` tells
    whether the element is a usable event. Never fails on a bad element."""
    known = ", ".join(f"'{t}'" for t in EVENT_TYPES)
    elements = batches.select(
        "batch_id",
        "ingest_time_ms",
        F.expr(parse_whole("body")).alias("_doc"),
    ).select(
        "batch_id",
        "ingest_time_ms",
        F.posexplode_outer(F.expr(from_list_or_envelope("_doc", "array<variant>"))).alias(
            "idx", "v"
        ),
    )
    names = (
        "event_type",
        "session_id",
        "player",
        "device",
        "timestamp",
        "startup_time_ms",
        "buffer_duration_ms",
        "bitrate_kbps",
        "watch_time_ms",
        "error_code",
    )
    raw = elements.where("idx IS NOT NULL").selectExpr(
        "batch_id", "ingest_time_ms", "idx", *[f"{member('v', n)} AS {n}" for n in names]
    )
    int32 = lambda f: f"try_cast({integer(f)} AS INT) AS {f}"
    kind = text("event_type", absent="NULL", wrong="NULL")
    stamp = f"coalesce({integer('timestamp')}, 0)"
    return raw.selectExpr(
        "batch_id",
        "ingest_time_ms",
        "idx",
        f"coalesce({is_text('event_type')} AND {kind} IN ({known}) AND {stamp} BETWEEN"
        f" {MIN_TIMESTAMP_MS} AND {MAX_TIMESTAMP_MS}, false) AS parsed",
        f"{kind} AS event_type",
        f"{text('session_id')} AS session_id",
        f"{text('player')} AS player",
        f"{text('device')} AS device",
        f"{stamp} AS timestamp_ms",
        int32("startup_time_ms"),
        int32("buffer_duration_ms"),
        int32("bitrate_kbps"),
        f"{integer('watch_time_ms')} AS watch_time_ms",
        f"{text('error_code', absent='NULL', wrong='NULL')} AS error_code",
    )


def parsed_events(elements: DataFrame) -> DataFrame:
    return elements.where("parsed").drop("parsed")


def known_events(events: DataFrame) -> DataFrame:
    """Typed events whose name is one of the closed set."""
    return events.where(F.col("event_type").isin(*EVENT_TYPES))


def parse_counts(elements: DataFrame) -> DataFrame:
    """Elements read, events among them, and failures."""
    return elements.agg(
        F.count(F.lit(1)).alias("n_elements"),
        F.count_if("parsed").alias("n_events"),
        F.count_if(~F.col("parsed")).alias("parse_failures"),
    )
