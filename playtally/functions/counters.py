"""The counter kernel: eleven additive measures and what is derived from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtally.schema import COUNTERS, METRICS, MINUTE_METRICS


def usable(event_type: str, payload: str) -> str:
    """The payload of events of one type; NULL when absent or negative."""
    return (
        f"CASE WHEN event_type = '{event_type}' AND {payload} >= 0"
        f" THEN CAST({payload} AS BIGINT) END"
    )


def _tally(event_type: str) -> str:
    return f"count_if(event_type = '{event_type}')"


def _total(value: str) -> str:
    return f"coalesce(sum({value}), 0L)"


def counter_aggs() -> list[Column]:
    """Aggregates that fold typed events into the counters.

    All are counts and integer sums: partial aggregation applies, order never
    matters, and a hot key shrinks to one row per task before any shuffle.
    """
    startup = usable("startup_complete", "startup_time_ms")
    stall = usable("buffer_end", "buffer_duration_ms")
    watch = usable("playback_end", "watch_time_ms")
    bitrate = usable("bitrate_change", "bitrate_kbps")
    folds = {
        "total_events": "count(1)",
        "total_views": _tally("video_start"),
        "startup_samples": f"count({startup})",
        "startup_time_ms_sum": _total(startup),
        "buffer_count": _tally("buffer_start"),
        "buffer_samples": f"count({stall})",
        "buffer_duration_ms_sum": _total(stall),
        "error_count": _tally("drm_error"),
        "watch_time_ms_sum": _total(watch),
        "bitrate_samples": f"count({bitrate})",
        "bitrate_kbps_sum": _total(bitrate),
    }
    return [F.expr(f"{folds[name]} AS {name}") for name in COUNTERS]


def merge_aggs() -> list[Column]:
    """Aggregates that add counter rows together."""
    return [F.expr(f"{_total(name)} AS {name}") for name in COUNTERS]


def zero_counters() -> list[Column]:
    return [F.expr(f"0L AS {name}") for name in COUNTERS]


def _ratio(numerator: str, denominator: str) -> str:
    return (
        f"CASE WHEN {denominator} > 0"
        f" THEN CAST({numerator} AS DOUBLE) / CAST({denominator} AS DOUBLE) ELSE 0.0D END"
    )


# Measures computed on read; 0.0, never NULL, when there is no sample.
DERIVED = {
    "startup_avg_ms": _ratio("startup_time_ms_sum", "startup_samples"),
    # Stalls that ended here, not stalls that began here.
    "buffer_avg_ms": _ratio("buffer_duration_ms_sum", "buffer_samples"),
    "buffer_ratio_per_view": _ratio("buffer_count", "total_views"),
    "watch_time_ms": "watch_time_ms_sum",
    "watch_time_min": "CAST(watch_time_ms_sum AS DOUBLE) / 60000.0D",
    "bitrate_avg_kbps": _ratio("bitrate_kbps_sum", "bitrate_samples"),
}


def derived(*names: str) -> list[Column]:
    return [F.expr(f"{DERIVED[name]} AS {name}") for name in names]


def error_rate() -> Column:
    return F.expr(f"{_ratio('error_count', 'total_events')} AS error_rate")


def metric_columns(with_ratio: bool = True) -> list[Column]:
    """The published metrics of one counter row, in contract order."""
    names = (METRICS if with_ratio else MINUTE_METRICS).names
    return [F.expr(f"{DERIVED.get(n, n)} AS {n}") for n in names]


def as_metrics(
    counters: DataFrame, keys: Iterable[str] = (), with_ratio: bool = True
) -> DataFrame:
    """``keys`` plus the published metrics of every counter row."""
    return counters.select(*keys, *metric_columns(with_ratio))


def used(*columns: str) -> list[Column]:
    """Aggregates that keep ``columns`` in the input of a branch, see :func:`all_used`."""
    return [F.max(c).alias(f"_used_{c}") for c in columns]


def all_used(*columns: str) -> Column:
    """A test that always holds and needs what :func:`used` made.

    Two branches read one exchange only if neither leaves out a column of it.
    """
    return F.hash(*[F.col(f"_used_{c}") for c in columns]) >= F.lit(-(1 << 31))
