"""Active sessions: starts minus ends, never below zero.

The gauge is floored at every step, so it is not a plain running sum. With
``S`` the running sum of steps, its value is ``S - min(0, lowest S so far)``.
A run of consecutive steps is fully described by its sum and its lowest prefix
sum, and two runs combine into one, so runs can be folded anywhere and only
the (sum, lowest) pairs put in sequence:

1. steps are range-partitioned by their order; the order is unique, so a hot
   minute or session is split over as many tasks as it needs;
2. each task folds its stretch to one pair per run of one minute, streaming;
3. pairs are put in sequence within a task's part, then parts among each other.
   The last step has one row per part.

The order alone decides what comes first, be it event time or arrival. A
minute may come up in several runs; its gauge is that of the last one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playtally.functions.minutes import minute_of

# Executors get the fold itself, they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Columns that put steps in a unique order.
ORDER = ("timestamp_ms", "event_id")
ARRIVAL = ("ingest_time_ms", "batch_id", "idx")

_RUNS = "part int, seq bigint, minute_ms bigint, moves bigint, net bigint, lowest bigint"


def _fold_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum and lowest prefix sum of every stretch of one minute, in order."""
    context = TaskContext.get()
    part, seq = (context.partitionId() if context else 0), 0
    held: list[int] | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        minute, step = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        starts = np.flatnonzero(np.r_[True, minute[1:] != minute[:-1]])
        ends = np.r_[starts[1:], len(minute)] - 1
        running = np.cumsum(step)
        before = running[starts] - step[starts]
        runs = np.column_stack(
            (
                minute[starts],
                ends - starts + 1,
                running[ends] - before,
                np.minimum.reduceat(running, starts) - before,
            )
        ).astype(np.int64)
        if held is not None:
            if held[0] == runs[0, 0]:
                # The stretch goes on from the last batch.
                runs[0, 3] = min(held[3], held[2] + runs[0, 3])
                runs[0, 1:3] += held[1:3]
            else:
                runs = np.vstack((np.array(held, dtype=np.int64), runs))
        held = runs[-1].tolist()
        if len(runs) > 1:
            yield _as_batch(part, seq, runs[:-1])
            seq += len(runs) - 1
    if held is not None:
        yield _as_batch(part, seq, np.array([held], dtype=np.int64))


def _as_batch(part: int, seq: int, runs: np.ndarray) -> pa.RecordBatch:
    names = ("minute_ms", "moves", "net", "lowest")
    columns = [pa.array(np.ascontiguousarray(runs[:, i])) for i in range(len(names))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(runs), part, dtype=np.int32)),
            pa.array(np.arange(seq, seq + len(runs), dtype=np.int64)),
            *columns,
        ],
        names=["part", "seq", *names],
    )


def session_runs(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """(sum, lowest prefix) of every run of one minute, by part and place in it."""
    step = F.when(F.col("event_type") == "video_start", 1).otherwise(-1)
    keys = [f"_order{i}" for i in range(len(order))]
    steps = events.where(F.col("event_type").isin("video_start", "playback_end")).select(
        minute_of(F.col("timestamp_ms")).alias("minute_ms"),
        step.cast("bigint").alias("step"),
        *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)],
    )
    return (
        steps.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("minute_ms", "step")
        .mapInArrow(_fold_runs, _RUNS)
    )


def active_sessions(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Gauge after the last step of every minute that has a start or an end."""
    return gauge_of_runs(session_runs(events, order))


def gauge_of_runs(runs: DataFrame) -> DataFrame:
    """One row per minute; ``last`` is (part, seq) of its last run."""
    in_part = W.partitionBy("part").orderBy("seq")
    earlier = in_part.rowsBetween(W.unboundedPreceding, -1)
    so_far = in_part.rowsBetween(W.unboundedPreceding, W.currentRow)
    zero = F.lit(0).cast("bigint")

    parted = runs.withColumn("before", F.coalesce(F.sum("net").over(earlier), zero)).withColumn(
        "low", F.min(F.col("before") + F.col("lowest")).over(so_far)
    )
    # One row per part from here on: as many as there are tasks.
    in_turn = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = (
        parted.groupBy("part")
        .agg(F.sum("net").alias("part_net"), F.min("low").alias("part_low"))
        .withColumn("carry", F.coalesce(F.sum("part_net").over(in_turn), zero))
        .withColumn(
            "carry_low", F.coalesce(F.min(F.col("carry") + F.col("part_low")).over(in_turn), zero)
        )
        .select("part", "carry", "carry_low")
    )
    level = F.col("carry") + F.col("before") + F.col("net")
    floor = F.least(zero, F.col("carry_low"), F.col("carry") + F.col("low"))
    place = F.struct("part", "seq")
    return (
        parted.join(parts, "part")
        .groupBy("minute_ms")
        .agg(F.max_by(level - floor, place).alias("active_sessions"), F.max(place).alias("last"))
    )


def current_sessions(gauge: DataFrame) -> DataFrame:
    """The gauge after the last step; 0 without any."""
    return gauge.agg(
        F.coalesce(F.max_by("active_sessions", "last"), F.lit(0).cast("bigint")).alias(
            "active_sessions"
        )
    )
