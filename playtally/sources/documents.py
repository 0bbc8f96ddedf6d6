"""JSON documents of query results, one row with one text each.

For answers of bounded size: a live or range answer has at most the response
cap of minutes, a breakdown at most the label cap of names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtally.functions.counters import metric_columns
from playtally.functions.minutes import iso_minute
from playtally.operators import rollups


def overall_document(minutes: DataFrame) -> DataFrame:
    """``{"totals": {...}, "minutes_tracked": n}``"""
    return rollups.overall(minutes).select(
        F.to_json(
            F.struct(F.struct(*metric_columns()).alias("totals"), "minutes_tracked")
        ).alias("doc")
    )


def _minute_list(points: DataFrame) -> DataFrame:
    entry = F.struct(
        F.col("minute_ms"),
        F.struct(
            iso_minute(F.col("minute_ms")).alias("minute"),
            F.struct(*metric_columns(with_ratio=False)).alias("metrics"),
        ).alias("entry"),
    )
    return points.agg(F.sort_array(F.collect_list(entry)).alias("sorted")).select(
        F.transform("sorted", lambda x: x["entry"]).alias("minutes")
    )


def live_document(points: DataFrame) -> DataFrame:
    """``{"minutes": [{"minute": ..., "metrics": {...}}, ...]}``"""
    return _minute_list(points).select(F.to_json(F.struct("minutes")).alias("doc"))


def range_document(points: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """As the live document, with the bounds cut to their minutes."""
    bound = lambda ms, name: iso_minute(F.lit(ms).cast("bigint")).alias(name)
    return _minute_list(points).select(
        F.to_json(F.struct(bound(from_ms, "from"), bound(to_ms, "to"), "minutes")).alias("doc")
    )


def segments_document(segments: DataFrame, section: str) -> DataFrame:
    """``{"players": [{"name": ..., "metrics": {...}}, ...]}``, by name."""
    entry = F.struct("name", F.struct(*metric_columns()).alias("metrics"))
    return segments.agg(F.sort_array(F.collect_list(entry)).alias(section)).select(
        F.to_json(F.struct(section)).alias("doc")
    )


def status_document(status: DataFrame) -> DataFrame:
    return status.select(F.to_json(F.struct(*status.columns)).alias("doc"))
