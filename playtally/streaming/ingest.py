"""Continuous ingest: verdicts, rollups, label slots and the session gauge.

The streaming plan itself is stateless (judge each batch in its row). All
state is kept as tables written per micro-batch under the epoch number, and
every write replaces its epoch, so a micro-batch that is run again after a
failure leaves exactly what one run leaves. A batch that a client sends twice
is two batches and counts twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from playtally.functions.counters import counter_aggs
from playtally.operators import gauge, labels, rollups
from playtally.operators.validate import (
    ACCEPTED,
    events_of,
    judged_elements,
    ledger_of,
    refused,
    untyped_events,
    with_verdict,
)
from playtally.options import IngestLimits, RollupOptions
from playtally.schema import OVERFLOW_LABEL
from playtally.sources.store import RollupStore, only_missing_path

OBSERVATION = "ingest"


class LabelSlots:
    """Which labels of each dimension have a row of their own, per epoch.

    A slot, once taken, is never given up, and at most ``max_segments`` exist
    per dimension, so the table stays small however long the stream runs.
    """

    _SCHEMA = "dimension string, name string, epoch_id bigint"

    def __init__(
        self, spark: SparkSession, path: str, options: RollupOptions, store: RollupStore | None = None
    ):
        self.spark = spark
        self.path = path
        self.options = options
        self.store = store

    def taken(self, before_epoch: int) -> DataFrame:
        """Slots taken before an epoch, and those of published labels: restored ones have no other place."""
        try:
            table = self.spark.read.schema(self._SCHEMA).parquet(self.path)
        except AnalysisException as error:
            only_missing_path(error)
            table = self.spark.createDataFrame([], self._SCHEMA)
        table = table.where(F.col("epoch_id") < before_epoch).select("dimension", "name")
        return table if self.store is None else table.unionByName(self.store.published_names()).distinct()

    def assign(self, events: DataFrame, epoch_id: int) -> DataFrame:
        """Events of a micro-batch with labels beyond the cap folded.

        ``folds`` is the number of labels of the event that were; the reserved
        name is no fold.
        """
        taken = self.taken(epoch_id)
        counts = taken.groupBy("dimension").agg(F.count(F.lit(1)).alias("n")).collect()
        used = {r["dimension"]: r["n"] for r in counts}
        fresh = None
        for dimension in rollups.DIMENSIONS:
            free = max(self.options.max_segments - used.get(dimension, 0), 0)
            if free == 0:
                continue
            old = taken.where(F.col("dimension") == dimension).select("name")
            new = (
                labels.first_seen(events, dimension, labels.arrival_key())
                .join(old, "name", "left_anti")
                .orderBy("arrival", "name")
                .limit(free)
                .select(F.lit(dimension).alias("dimension"), "name")
            )
            fresh = new if fresh is None else fresh.unionByName(new)
        # Only epochs that bring a new label leave a file.
        if fresh is not None:
            fresh = fresh.coalesce(1).persist()
            if not fresh.isEmpty():
                fresh.write.mode("overwrite").parquet(f"{self.path}/epoch_id={epoch_id}")
            fresh.unpersist()
        slots = self.taken(epoch_id + 1)
        events = events.withColumn("folds", F.lit(0))
        for dimension in rollups.DIMENSIONS:
            known = slots.where(F.col("dimension") == dimension).select(F.col("name").alias("_known"))
            label = F.col(dimension)
            folded = F.col("_known").isNull() & ~label.isin("", OVERFLOW_LABEL)
            events = (
                events.join(known, label == F.col("_known"), "left")
                .withColumn("folds", F.col("folds") + folded.cast("int"))
                .withColumn(
                    dimension,
                    F.when((label == "") | F.col("_known").isNotNull(), label).otherwise(
                        F.lit(OVERFLOW_LABEL)
                    ),
                )
                .drop("_known")
            )
        return events


class SessionGauge:
    """Active sessions after every epoch, carried from one to the next."""

    _SCHEMA = "active_sessions bigint, epoch_id bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def _table(self) -> DataFrame:
        try:
            return self.spark.read.schema(self._SCHEMA).parquet(self.path)
        except AnalysisException as error:
            only_missing_path(error)
            return self.spark.createDataFrame([], self._SCHEMA)

    def current(self, before_epoch: int | None = None) -> int:
        """Level after the latest epoch, or after the one before an epoch."""
        if before_epoch is not None:
            # Epochs are numbered without gaps: read just the one before.
            try:
                last = self.spark.read.schema("active_sessions bigint").parquet(
                    f"{self.path}/epoch_id={before_epoch - 1}"
                )
            except AnalysisException as error:
                only_missing_path(error)
                last = self._table().where(F.col("epoch_id") < before_epoch)
                return last.agg(F.max_by("active_sessions", "epoch_id")).first()[0] or 0
            return last.first()[0]
        return self._table().agg(F.max_by("active_sessions", "epoch_id")).first()[0] or 0

    def advance(self, events: DataFrame, epoch_id: int) -> None:
        """Fold the steps of a micro-batch onto the level before it.

        The level enters as that many starts ahead of everything else.
        """
        level = self.current(epoch_id)
        runs = gauge.session_runs(events, ("timestamp_ms", *gauge.ARRIVAL))
        ahead = self.spark.createDataFrame([(-1, 0, 0, level, level, 0)], runs.schema)
        value = gauge.current_sessions(gauge.gauge_of_runs(runs.unionByName(ahead)))
        value.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/epoch_id={epoch_id}")


def observed(judged: DataFrame) -> DataFrame:
    """Attach ingest counters to the progress of the query (no extra pass)."""
    ok = F.col("status") == ACCEPTED
    return judged.observe(
        OBSERVATION,
        F.count(F.lit(1)).alias("batches"),
        F.count_if(ok).alias("accepted_batches"),
        F.count_if(~ok).alias("rejected_batches"),
        F.coalesce(F.sum(F.when(ok, F.col("n_events"))), F.lit(0)).alias("events"),
        F.count_if(F.col("status") == "invalid_json").alias("unparseable_batches"),
        F.coalesce(F.sum(F.when(ok, F.expr(untyped_events()))), F.lit(0)).alias("parse_failures"),
    )


class EpochWriter:
    """Stores one judged micro-batch: gauge, slots, rollup, ledger and quarantine.

    All of it comes from one pass over the bodies, whose outcome is kept until
    the epoch is written. Every table replaces its epoch, so an epoch that is
    run again leaves what one run leaves.
    """

    def __init__(self, spark: SparkSession, root: str, options: RollupOptions = RollupOptions()):
        self.store = RollupStore(spark, root)
        self.slots = LabelSlots(spark, f"{root}/label_slots", options, self.store)
        self.sessions = SessionGauge(spark, f"{root}/session_gauge")

    def write(self, judged: DataFrame, epoch_id: int) -> None:
        elements = judged_elements(judged).persist()
        try:
            events = events_of(elements)
            self.sessions.advance(events, epoch_id)
            assigned = self.slots.assign(events, epoch_id)
            self.store.write_epoch(rollups.multi_rollup(assigned), epoch_id)
            folds = assigned.agg(F.coalesce(F.sum("folds"), F.lit(0))).first()[0]
            counts = ledger_of(elements).first().asDict()
            self.store.write_ledger({**counts, "segment_overflows": folds}, epoch_id)
            self.store.write_quarantine(refused(elements), epoch_id)
        finally:
            elements.unpersist()


class Ingest:
    """A running ingest. It behaves as its streaming query, and leaves no partial unpublished at a clean end.

    ``stop`` and a return of ``awaitTermination`` after the query ended without
    an error fold what is left into a published snapshot, once. After an error
    nothing is folded; the restarted stream goes on from its checkpoint.
    """

    def __init__(self, query: StreamingQuery, store: RollupStore, publish_at_end: bool):
        self.query = query
        self.store = store
        self._open = publish_at_end

    def __getattr__(self, name: str):
        return getattr(self.query, name)

    def _finish(self) -> None:
        if self._open and not self.query.isActive and self.query.exception() is None:
            self._open = False
            self.store.compact(self.store.last_epoch())

    def stop(self) -> None:
        self.query.stop()
        self._finish()

    def awaitTermination(self, timeout: int | None = None) -> bool | None:  # noqa: N802
        ended = self.query.awaitTermination() if timeout is None else self.query.awaitTermination(timeout)
        self._finish()
        return ended


def start_ingest(
    batches: DataFrame,
    root: str,
    checkpoint: str,
    limits: IngestLimits = IngestLimits(),
    options: RollupOptions = RollupOptions(),
    interval: str | None = None,
    compact_every: int = 100,
) -> Ingest:
    """Judge, roll up and store a stream of raw batches.

    ``interval`` is the trigger period; without one everything available is
    processed and the query ends. Every ``compact_every`` epochs, and at a clean
    end, the partials are folded into a new published snapshot and what it
    replaces is deleted; 0 leaves that to the caller. Labels that were restored
    (:meth:`RollupStore.restore`), before the stream or between two of its epochs,
    hold their slots.
    """
    writer = EpochWriter(batches.sparkSession, root, options)

    def handle(judged: DataFrame, epoch_id: int) -> None:
        writer.write(judged, epoch_id)
        if compact_every and (epoch_id + 1) % compact_every == 0:
            writer.store.compact(epoch_id)
            writer.store.vacuum()

    sink = (
        observed(with_verdict(batches, limits))
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(handle)
    )
    sink = sink.trigger(processingTime=interval) if interval else sink.trigger(availableNow=True)
    return Ingest(sink.start(), writer.store, compact_every > 0)


def minute_windows(events: DataFrame, limits: IngestLimits = IngestLimits()) -> DataFrame:
    """Minute rollup as a stateful stream over one-minute event-time windows.

    The watermark spans everything the freshness rule lets in, so it only ends
    state that no accepted event can still reach.
    """
    delay = limits.max_lateness_ms + limits.max_future_skew_ms
    timed = events.withColumn("event_ts", F.timestamp_millis("timestamp_ms"))
    return (
        timed.withWatermark("event_ts", f"{delay} milliseconds")
        .groupBy(F.window("event_ts", "1 minute"))
        .agg(*counter_aggs())
        .withColumn("minute_ms", F.unix_millis(F.col("window.start")))
        .drop("window")
    )


def drop_resent(batches: DataFrame, limits: IngestLimits = IngestLimits()) -> DataFrame:
    """Optional: count a batch sent again with the same id only once.

    Off by default. Works on a stream (bounded state) and on a batch.
    """
    if not batches.isStreaming:
        return batches.dropDuplicates(["batch_id"])
    delay = limits.max_lateness_ms + limits.max_future_skew_ms
    return (
        batches.withColumn("_received", F.timestamp_millis("ingest_time_ms"))
        .withWatermark("_received", f"{delay} milliseconds")
        .dropDuplicatesWithinWatermark(["batch_id"])
        .drop("_received")
    )
