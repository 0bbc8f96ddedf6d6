"""Label cap: the first N labels keep their row, all others share one.

"First" is by arrival, see :func:`arrival_key`; labels that arrive at once are
taken by name.

Events are aggregated once, to one row per label with its counters and first
arrival. The first N of those rows are the tracked ones, and what all rows
have more than the tracked ones is the shared row. Both read the same exchange,
so the input is read and judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtally.functions.counters import counter_aggs, merge_aggs
from playtally.options import RollupOptions
from playtally.operators import rollups
from playtally.schema import COUNTERS, OVERFLOW_LABEL


def arrival_key() -> Column:
    """Arrival of an event: receipt time, then batch, then position in it."""
    return F.struct("ingest_time_ms", "batch_id", F.col("idx").cast("bigint").alias("idx"))


def _named(events: DataFrame, label: str) -> DataFrame:
    return events.where((F.col(label) != "") & (F.col(label) != OVERFLOW_LABEL))


def first_seen(events: DataFrame, label: str, arrival: Column | str) -> DataFrame:
    """Arrival of the first event of every label."""
    return (
        _named(events, label)
        .groupBy(F.col(label).alias("name"))
        .agg(F.min(arrival).alias("arrival"))
    )


def tracked_labels(
    events: DataFrame,
    label: str,
    arrival: Column | str,
    options: RollupOptions = RollupOptions(),
    restored: DataFrame | None = None,
) -> DataFrame:
    """The labels that keep their own row, at most ``max_segments``.

    Restored labels take their slots before any live one. Slots are filled by
    a top-N over one row per label.
    """
    seen = first_seen(events, label, arrival).select(
        "name", F.lit(1).alias("live"), "arrival"
    )
    if restored is not None:
        # Restored names have no arrival; they come first all the same.
        kept = _named(restored, "name").select(
            "name", F.lit(0).alias("live"), F.lit(None).cast(seen.schema["arrival"].dataType).alias("arrival")
        )
        seen = (
            seen.unionByName(kept)
            .groupBy("name")
            .agg(F.min("live").alias("live"), F.min("arrival").alias("arrival"))
        )
    return seen.orderBy("live", _live_arrival(), "name").limit(options.max_segments).select("name")


def _live_arrival() -> Column:
    """Restored labels go by name alone."""
    return F.when(F.col("live") == 1, F.col("arrival"))


def _fold(rows: DataFrame, label: str, tracked: DataFrame, options: RollupOptions) -> DataFrame:
    """``rows`` with untracked labels replaced by the overflow label."""
    known = tracked.select(F.col("name").alias("_known"))
    if options.max_segments <= options.broadcast_segments:
        # At most max_segments names of bounded length: safe to broadcast.
        known = F.broadcast(known)
    return (
        rows.where(F.col(label) != "")
        .join(known, F.col(label) == F.col("_known"), "left")
        .withColumn(label, F.coalesce("_known", F.lit(OVERFLOW_LABEL)))
        .drop("_known")
    )


def fold_labels(
    events: DataFrame, label: str, tracked: DataFrame, options: RollupOptions = RollupOptions()
) -> DataFrame:
    """Events whose label is non-empty, untracked labels folded."""
    return _fold(events, label, tracked, options)


def _label_rows(
    events: DataFrame, label: str, arrival: Column | str, restored: DataFrame | None
) -> DataFrame:
    """One row per label: (name, counters, arrival), with restored ones also ``live``.

    The reserved name is among them.
    """
    arrived = arrival if isinstance(arrival, Column) else F.col(arrival)
    rows = (
        events.where(F.col(label) != "")
        .groupBy(F.col(label).alias("name"))
        .agg(*counter_aggs(), F.min(arrived).alias("arrival"))
    )
    if restored is None:
        return rows
    old = restored.where(F.col("name") != "").select(
        "name",
        *COUNTERS,
        F.lit(0).alias("live"),
        F.lit(None).cast(rows.schema["arrival"].dataType).alias("arrival"),
    )
    return (
        rows.withColumn("live", F.lit(1))
        .unionByName(old)
        .groupBy("name")
        .agg(*merge_aggs(), F.min("live").alias("live"), F.min("arrival").alias("arrival"))
    )


def _first_rows(rows: DataFrame, options: RollupOptions) -> DataFrame:
    """The tracked labels' rows, by a top-N."""
    # The reserved name comes last rather than being filtered out below: the
    # plan under the top-N stays the same as that of the totals.
    reserved = F.col("name") == OVERFLOW_LABEL
    order = ["live", _live_arrival()] if "live" in rows.columns else ["arrival"]
    first = rows.orderBy(reserved, *order, "name").limit(options.max_segments)
    return first.where(~reserved)


def capped_rollup(
    events: DataFrame,
    label: str,
    arrival: Column | str,
    options: RollupOptions = RollupOptions(),
    restored: DataFrame | None = None,
) -> DataFrame:
    """Rollup of a label under the cap, restored segments added in.

    The shared row shows only once it has events.
    """
    rows = _label_rows(events, label, arrival, restored)
    tracked = _first_rows(rows, options)
    # Nothing is pruned from the totals' input, or it would be another exchange.
    keys = [c for c in ("name", "live", "arrival") if c in rows.columns]
    signed = lambda frame, sign: frame.select(
        *[(F.lit(sign) * F.col(c)).alias(c) for c in COUNTERS], *keys
    )
    rest = (
        signed(rows, 1)
        .unionByName(signed(tracked, -1))
        .agg(*merge_aggs(), *[F.count(k).alias(f"_{k}") for k in keys])
        .where((F.col("total_events") > 0) & (F.col("_name") + F.col("_arrival") >= 0))
        .select(F.lit(OVERFLOW_LABEL).alias("name"), *COUNTERS)
    )
    return tracked.select("name", *COUNTERS).unionByName(rest)


def capped_rows(segments: DataFrame, options: RollupOptions = RollupOptions()) -> DataFrame:
    """Merged label rows under the cap: the first by name, all others in the shared row.

    Rows that are within the cap come back as they are. The shared row itself
    takes no place among the first.
    """
    reserved = F.col("name") == OVERFLOW_LABEL
    first = segments.where(~reserved).orderBy("name").limit(options.max_segments)
    signed = lambda frame, sign: frame.select(
        *[(F.lit(sign) * F.col(c)).alias(c) for c in COUNTERS], F.lit(sign).alias("_n"), (F.lit(sign) * reserved.cast("int")).alias("_r")
    )
    # All rows less the first ones: those folded, and the shared row.
    rest = (
        signed(segments, 1)
        .unionByName(signed(first, -1))
        .agg(*merge_aggs(), F.sum("_n").alias("_n"), F.sum("_r").alias("_r"))
        .where("_n > 0 AND _r >= 0")
        .select(F.lit(OVERFLOW_LABEL).alias("name"), *COUNTERS)
    )
    return first.select("name", *COUNTERS).unionByName(rest)


def overflow_count(
    events: DataFrame, label: str, arrival: Column | str, options: RollupOptions = RollupOptions()
) -> DataFrame:
    """Number of events folded into the shared row; those that already carry
    its name are not folds."""
    arrived = arrival if isinstance(arrival, Column) else F.col(arrival)
    rows = (
        events.where(F.col(label) != "")
        .groupBy(F.col(label).alias("name"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(arrived).alias("arrival"))
    )
    named = F.when(F.col("name") != OVERFLOW_LABEL, F.col("n")).otherwise(F.lit(0))
    every = rows.select(named.alias("n"), "arrival")
    kept = _first_rows(rows, options).select((-F.col("n")).alias("n"), "arrival")
    both = every.unionByName(kept).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("overflows"), F.count("arrival").alias("_arrival")
    )
    return both.where("_arrival >= 0").select("overflows")


def segment_overflows(
    events: DataFrame, arrival: Column | str, options: RollupOptions = RollupOptions()
) -> DataFrame:
    """Folds over players and devices together."""
    parts = [overflow_count(events, d, arrival, options) for d in rollups.DIMENSIONS]
    return parts[0].unionByName(parts[1]).agg(F.sum("overflows").alias("segment_overflows"))
