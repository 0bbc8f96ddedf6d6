"""Rates from counters sampled over time, and the status row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playtally.functions.counters import all_used, error_rate, merge_aggs, used
from playtally.functions.minutes import day_start
from playtally.options import DAY_MS
from playtally.schema import COUNTERS


def counter_rate(
    samples: DataFrame,
    series: str = "series",
    ts: str = "ts_ms",
    value: str = "value",
    tie: str | None = None,
    slice_ms: int = DAY_MS,
) -> DataFrame:
    """Change per second from one sample of a series to the next.

    0 for the first sample, for no time passed and for a counter that went
    back. A long series is cut into time slices, so that no task holds more
    than one slice of it; only the last sample of each slice is handed on to
    the next one.
    """
    order = [ts, tie] if tie else [ts]
    within = W.partitionBy(series, "slice").orderBy(*order)
    cut = samples.withColumn("slice", F.col(ts) - F.pmod(F.col(ts), F.lit(slice_ms).cast("bigint")))
    linked = (
        cut.withColumn("_prev_v", F.lag(value).over(within))
        .withColumn("_prev_t", F.lag(ts).over(within))
        .withColumn("_next_t", F.lead(ts).over(within))
    )
    across = W.partitionBy("_series").orderBy("_slice")
    handed = (
        linked.where(F.col("_next_t").isNull())
        .select(
            F.col(series).alias("_series"),
            F.col("slice").alias("_slice"),
            F.col(value).alias("_last_v"),
            F.col(ts).alias("_last_t"),
        )
        .select(
            "_series",
            "_slice",
            F.lag("_last_v").over(across).alias("_hand_v"),
            F.lag("_last_t").over(across).alias("_hand_t"),
        )
    )
    v, t = F.col(value), F.col(ts)
    prev_v, prev_t = F.coalesce("_prev_v", "_hand_v"), F.coalesce("_prev_t", "_hand_t")
    rate = F.when(
        prev_t.isNotNull() & (t > prev_t) & (v >= prev_v),
        (v - prev_v).cast("double") / ((t - prev_t).cast("double") / F.lit(1000.0)),
    ).otherwise(F.lit(0.0))
    # Null-safe, so that no filter is inferred and both sides of the join can
    # share the exchange of the samples.
    same = F.col(series).eqNullSafe(F.col("_series")) & F.col("slice").eqNullSafe(F.col("_slice"))
    return linked.join(handed, same, "left").select(*samples.columns, rate.alias("rate"))


def events_per_sec(minutes: DataFrame) -> DataFrame:
    """Running total of events and their rate since the bucket before.

    Worked out within days; a day hands on its total and its last bucket, and
    the running sum of days has one row per day.
    """
    zero = F.lit(0).cast("bigint")
    within = W.partitionBy("day").orderBy("minute_ms")
    across = W.orderBy("day")
    in_day = minutes.select(
        "minute_ms",
        "total_events",
        F.coalesce(day_start(F.col("minute_ms")), zero).alias("day"),
    )
    days = (
        in_day.groupBy("day")
        .agg(F.sum("total_events").alias("n"), F.max("minute_ms").alias("last"))
        .select(
            "day",
            F.coalesce(F.sum("n").over(across.rowsBetween(W.unboundedPreceding, -1)), zero).alias("carry"),
            F.lag("last").over(across).alias("day_before"),
        )
    )
    run = F.sum("total_events").over(within.rowsBetween(W.unboundedPreceding, 0))
    before = F.coalesce("prev", "day_before")
    seconds = (F.col("minute_ms") - before).cast("double") / F.lit(1000.0)
    return (
        in_day.withColumn("run", run)
        .withColumn("prev", F.lag("minute_ms").over(within))
        .join(days, "day")
        .select(
            "minute_ms",
            (F.col("carry") + F.col("run")).alias("running_events"),
            F.when(before.isNotNull(), F.col("total_events").cast("double") / seconds)
            .otherwise(F.lit(0.0))
            .alias("events_per_sec"),
        )
    )


def latest_rate(minutes: DataFrame) -> DataFrame:
    """:func:`events_per_sec` of the latest minute, from its two last buckets.

    Restored history is the baseline: only what came after it makes a rate.
    """
    last_two = minutes.orderBy(F.col("minute_ms").desc()).limit(2)
    span = (F.max("minute_ms") - F.min("minute_ms")).cast("double") / F.lit(1000.0)
    newest = F.max_by("total_events", "minute_ms").cast("double")
    rate = F.when(F.count(F.lit(1)) == 2, newest / span).otherwise(F.lit(0.0)).alias("events_per_sec")
    return last_two.agg(rate, *used(*COUNTERS)).where(all_used(*COUNTERS)).select("events_per_sec")


def status_row(minutes: DataFrame, current: DataFrame) -> DataFrame:
    """Totals, error rate, latest event rate and active sessions in one row.

    The three one-row inputs are stacked and collapsed, which needs no join.
    Totals and the latest rate read one exchange, so the events are rolled up once.
    """
    keys = ("minute_ms", *COUNTERS)
    totals = minutes.agg(*merge_aggs(), *used(*keys)).where(all_used(*keys))
    totals = totals.select("total_events", "error_count", error_rate())
    parts = totals.unionByName(latest_rate(minutes), allowMissingColumns=True).unionByName(
        current, allowMissingColumns=True
    )
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def ingest_stats(judged: DataFrame) -> DataFrame:
    """Batches and events by outcome, one row."""
    ok = F.col("status") == "accepted"
    return judged.agg(
        F.count(F.lit(1)).alias("batches"),
        F.count_if(ok).alias("accepted_batches"),
        F.count_if(~ok).alias("rejected_batches"),
        F.coalesce(F.sum(F.when(ok, F.col("n_events"))), F.lit(0)).cast("bigint").alias("events"),
        F.count_if(F.col("status") == "invalid_json").alias("unparseable_batches"),
    )
