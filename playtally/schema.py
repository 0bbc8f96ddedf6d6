"""Column layouts shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed set of event names on the wire.
EVENT_TYPES = (
    "video_start",
    "startup_complete",
    "buffer_start",
    "buffer_end",
    "pause",
    "resume",
    "seek",
    "bitrate_change",
    "drm_error",
    "playback_end",
)

# The additive counters, in the order results list them.
COUNTERS = (
    "total_events",
    "total_views",
    "startup_samples",
    "startup_time_ms_sum",
    "buffer_count",
    "buffer_samples",
    "buffer_duration_ms_sum",
    "error_count",
    "watch_time_ms_sum",
    "bitrate_samples",
    "bitrate_kbps_sum",
)

# Label under which everything beyond the label cap is counted.
OVERFLOW_LABEL = "__other__"

RAW_BATCHES = T.StructType(
    [
        T.StructField("batch_id", T.StringType(), False),
        T.StructField("ingest_time_ms", T.LongType(), False),
        T.StructField("body", T.StringType(), True),
    ]
)

PLAYBACK_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("player", T.StringType(), False),
        T.StructField("device", T.StringType(), False),
        T.StructField("timestamp_ms", T.LongType(), False),
        T.StructField("startup_time_ms", T.IntegerType(), True),
        T.StructField("buffer_duration_ms", T.IntegerType(), True),
        T.StructField("bitrate_kbps", T.IntegerType(), True),
        T.StructField("watch_time_ms", T.LongType(), True),
        T.StructField("error_code", T.StringType(), True),
    ]
)

# The members of a typed event that come from its JSON object.
EVENT_FIELDS = tuple(f.name for f in PLAYBACK_EVENTS.fields if f.name != "event_id")

_COUNTER_FIELDS = [T.StructField(c, T.LongType(), False) for c in COUNTERS]

MINUTE_ROLLUP = T.StructType(
    [T.StructField("minute_ms", T.LongType(), False), *_COUNTER_FIELDS]
)

SEGMENT_ROLLUP = T.StructType(
    [
        T.StructField("dimension", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        *_COUNTER_FIELDS,
    ]
)

# Every rollup of one pass in one table: exactly one of the two keys is set.
PARTIALS = T.StructType(
    [
        T.StructField("grain", T.StringType(), False),
        T.StructField("minute_ms", T.LongType(), True),
        T.StructField("name", T.StringType(), True),
        *_COUNTER_FIELDS,
    ]
)

# Ingest counters of an epoch, or summed over epochs.
LEDGER = T.StructType(
    [
        T.StructField(name, T.LongType(), False)
        for name in (
            "batches",
            "accepted_batches",
            "rejected_batches",
            "unparseable_batches",
            "events",
            "parse_failures",
            "process_errors",
            "segment_overflows",
        )
    ]
)

# What ingest refused: whole batches (no index) or single elements.
QUARANTINE = T.StructType(
    [
        T.StructField("batch_id", T.StringType(), True),
        T.StructField("ingest_time_ms", T.LongType(), True),
        T.StructField("idx", T.IntegerType(), True),
        T.StructField("reason", T.StringType(), True),
        T.StructField("message", T.StringType(), True),
        T.StructField("raw", T.StringType(), True),
    ]
)

_METRIC_FIELDS = [
    ("total_events", T.LongType()),
    ("total_views", T.LongType()),
    ("startup_samples", T.LongType()),
    ("startup_avg_ms", T.DoubleType()),
    ("buffer_count", T.LongType()),
    ("buffer_samples", T.LongType()),
    ("buffer_avg_ms", T.DoubleType()),
    ("buffer_ratio_per_view", T.DoubleType()),
    ("error_count", T.LongType()),
    ("watch_time_ms", T.LongType()),
    ("watch_time_min", T.DoubleType()),
    ("bitrate_samples", T.LongType()),
    ("bitrate_avg_kbps", T.DoubleType()),
]

# Result contract of totals and segments.
METRICS = T.StructType([T.StructField(n, t) for n, t in _METRIC_FIELDS])

# Result contract of one minute: stalls per view mean nothing inside a single
# minute (the view and its stalls fall in different ones), so it is left out.
MINUTE_METRICS = T.StructType(
    [T.StructField(n, t) for n, t in _METRIC_FIELDS if n != "buffer_ratio_per_view"]
)

# Metrics that exist for every population and can be charted.
PLOTTABLE = tuple(MINUTE_METRICS.names)
