"""Data-quality report on the shape of sessions.

A well-formed session starts with ``video_start`` and ends with
``playback_end``, stays on one player and one device, never goes back in time,
and its watch time is the time between its first and last event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def session_audit(
    events: DataFrame, arrival: str = "event_id", slice_size: int = 1_000_000
) -> DataFrame:
    """One row per session with the outcome of every check.

    Order is by a BIGINT arrival column. A session is cut into slices of
    arrival numbers, each sorted on its own, so that one endless session does
    not end up in one task; what a slice says of itself is a single row.
    """
    at = F.col(arrival)
    ts = F.col("timestamp_ms")
    within = W.partitionBy("session_id", "slice").orderBy("at")
    steps = events.select(
        "session_id",
        at.alias("at"),
        (at - F.pmod(at, F.lit(slice_size).cast("bigint"))).alias("slice"),
        ts,
        "player",
        "device",
        (F.col("event_type") == "video_start").alias("is_start"),
        (F.col("event_type") == "playback_end").alias("is_end"),
        "watch_time_ms",
    ).withColumn(
        "back",
        (ts < F.lag("timestamp_ms").over(within)).cast("int"),
    )
    # Partitioned by (session, slice) already: both groupings shuffle nothing.
    labelled = steps.groupBy("session_id", "slice", "player", "device").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("back"), F.lit(0)).alias("back"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.min_by("timestamp_ms", "at").alias("first_ts"),
        F.max_by("timestamp_ms", "at").alias("last_ts"),
        F.min_by("is_start", "at").alias("is_start"),
        F.max_by("is_end", "at").alias("is_end"),
        F.max_by("watch_time_ms", "at").alias("watch"),
    )
    sliced = labelled.groupBy("session_id", "slice").agg(
        F.sum("n").alias("n"),
        F.sum("back").alias("back"),
        F.min_by("first_ts", "first_at").alias("first_ts"),
        F.max_by("last_ts", "last_at").alias("last_ts"),
        F.min_by("is_start", "first_at").alias("is_start"),
        F.max_by("is_end", "last_at").alias("is_end"),
        F.max_by("watch", "last_at").alias("watch"),
        F.min("player").alias("min_player"),
        F.max("player").alias("max_player"),
        F.min("device").alias("min_device"),
        F.max("device").alias("max_device"),
    )
    across = W.partitionBy("session_id").orderBy("slice")
    joined = sliced.withColumn(
        "back_across",
        (F.col("first_ts") < F.lag("last_ts").over(across)).cast("int"),
    )
    whole = joined.groupBy("session_id").agg(
        F.sum("n").alias("n_events"),
        (F.sum("back") + F.coalesce(F.sum("back_across"), F.lit(0))).alias("steps_back"),
        F.min_by("first_ts", "slice").alias("first_ts"),
        F.max_by("last_ts", "slice").alias("last_ts"),
        F.min_by("is_start", "slice").alias("starts_ok"),
        F.max_by("is_end", "slice").alias("ends_ok"),
        F.max_by("watch", "slice").alias("watch"),
        (F.min("min_player") == F.max("max_player")).alias("one_player"),
        (F.min("min_device") == F.max("max_device")).alias("one_device"),
    )
    watch_ok = F.coalesce(
        F.col("ends_ok") & (F.col("watch") == F.col("last_ts") - F.col("first_ts")), F.lit(False)
    )
    checks = whole.select(
        "session_id",
        "n_events",
        "steps_back",
        "starts_ok",
        "ends_ok",
        "one_player",
        "one_device",
        (F.col("steps_back") == 0).alias("in_order"),
        watch_ok.alias("watch_ok"),
    )
    good = F.lit(True)
    for check in ("starts_ok", "ends_ok", "one_player", "one_device", "in_order", "watch_ok"):
        good = good & F.col(check)
    return checks.withColumn("well_formed", good)
