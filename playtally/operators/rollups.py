"""Additive rollups of typed events.

Every one is a hash aggregation of counts and integer sums. A task reduces its
rows to one per key before the shuffle, so a key that holds a third of all
events costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtally.functions.counters import counter_aggs, merge_aggs
from playtally.functions.minutes import minute_of
from playtally.schema import COUNTERS

DIMENSIONS = ("player", "device")


def totals_direct(events: DataFrame) -> DataFrame:
    """Counters of all events; one row of zeroes for no events."""
    return events.agg(*counter_aggs())


def by_minute(events: DataFrame) -> DataFrame:
    """One row per UTC minute that has events."""
    return events.groupBy(minute_of(F.col("timestamp_ms")).alias("minute_ms")).agg(
        *counter_aggs()
    )


def by_label(events: DataFrame, label: str) -> DataFrame:
    """One row per value of a label column; the empty label is no segment."""
    return (
        events.where(F.col(label) != "")
        .groupBy(F.col(label).alias("name"))
        .agg(*counter_aggs())
    )


def multi_rollup(events: DataFrame, fold_first: bool = False) -> DataFrame:
    """Minute, player and device rollup in one scan.

    Rows carry ``grain`` and either ``minute_ms`` or ``name``.

    By default every event is expanded to its three keys and there is one
    shuffle, of rows reduced per task to one for each minute, player and device.
    With ``fold_first`` events are reduced to their combinations of the three
    before that, which saves the expansion but shuffles the combinations. It pays
    where they are much fewer than events: see :func:`folds_well`. Both give the
    same rows.
    """
    keyed = events.withColumn("minute_ms", minute_of(F.col("timestamp_ms")))
    minute, player, device = (F.col(c) for c in ("minute_ms", "player", "device"))
    aggs = counter_aggs()
    if fold_first:
        keyed = keyed.groupBy(minute, player, device).agg(*aggs)
        aggs = merge_aggs()
    grouped = keyed.groupingSets(
        [[minute], [player], [device]], minute, player, device
    ).agg(F.grouping_id().alias("gid"), *aggs)
    # Bits of gid, high to low, mark the keys that are aggregated away.
    grain = (
        F.when(F.col("gid") == 0b011, "minute").when(F.col("gid") == 0b101, "player").otherwise("device")
    )
    name = F.when(F.col("gid") == 0b101, player).when(F.col("gid") == 0b110, device)
    return grouped.select(
        grain.alias("grain"), "minute_ms", name.alias("name"), *COUNTERS
    ).where((F.col("grain") == "minute") | (F.col("name") != ""))


def folds_well(events: DataFrame, rows: int = 100_000, least: int = 8) -> bool:
    """Whether the first ``rows`` events have ``least`` or more to a combination of minute, player and device.

    That is how far a task shrinks its share before the shuffle of
    ``multi_rollup(events, fold_first=True)``. A job over a bounded number of
    rows; it decides on the plan alone, never on the outcome. False for no events.
    """
    head = events.select(minute_of(F.col("timestamp_ms")).alias("minute_ms"), "player", "device").limit(rows)
    sizes = head.groupBy("minute_ms", "player", "device").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("combinations")).first()
    return bool(found.n) and found.n >= least * found.combinations


def minutes_of(partials: DataFrame) -> DataFrame:
    """The minute rows of a (merged or unmerged) multi rollup."""
    return partials.where(F.col("grain") == "minute").select("minute_ms", *COUNTERS)


def segments_of(partials: DataFrame, dimension: str) -> DataFrame:
    """The rows of one label dimension of a multi rollup."""
    return partials.where(F.col("grain") == dimension).select("name", *COUNTERS)


def merge(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up rows that share a key; the same key may come many times."""
    return partials.groupBy(*keys).agg(*merge_aggs())


def merge_multi(partials: DataFrame) -> DataFrame:
    return merge(partials, ("grain", "minute_ms", "name"))


def totals(minutes: DataFrame) -> DataFrame:
    """Platform totals: the sum of all minute buckets, restored ones included."""
    return minutes.agg(*merge_aggs())


def minute_count(minutes: DataFrame) -> DataFrame:
    """Number of distinct minutes among rows that may repeat a minute."""
    return minutes.agg(F.count_distinct("minute_ms").alias("minutes_tracked"))


def overall(minutes: DataFrame) -> DataFrame:
    """Totals and number of minutes, from merged minute buckets (one row)."""
    return minutes.agg(*merge_aggs(), F.count(F.lit(1)).alias("minutes_tracked"))
