"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.functions import minutes as M
from playtally.functions.counters import as_metrics, derived, usable
from playtally.operators import (
    gauge,
    labels,
    parse,
    rates,
    rollups,
    sessions,
    snapshot,
    timeseries,
    validate,
)
from playtally.options import IngestLimits, QueryLimits, RollupOptions
from playtally.plans.reads import PlaybackMetrics
from playtally.schema import COUNTERS, METRICS, MINUTE_METRICS, OVERFLOW_LABEL
from playtally.session import scratch
from playtally.sources import raw
from playtally.sources.store import RollupStore
from playtally.sources.testdata import playback_events, raw_batches, wide_labels
from playtally.streaming.ingest import EpochWriter, LabelSlots

Query = Callable[[SparkSession, str], DataFrame]

# Arguments of the parameterised queries; the oracle uses the same values.
POINT_MS = 1_704_075_750_123
RANGE_MS = (1_704_500_012_345, 1_704_585_000_000)
LIVE_BUCKETS = 30
FILL_BUCKETS = 60
CLAMP = QueryLimits(max_minutes=100)
PLAYER_CAP = RollupOptions(max_segments=10)
DEVICE_CAP = RollupOptions(max_segments=3)
RESTORE_CAP = RollupOptions(max_segments=8)
STORE_CAP = RollupOptions(max_segments=8)
LEDGER_CAP = RollupOptions(max_segments=3)
EPOCHS = 3
BACKLOG = 100
TIGHT = IngestLimits(
    max_body_bytes=60_000, max_structural_tokens=5_000, max_events_per_batch=60
)
SHORT_WINDOW = IngestLimits(max_lateness_ms=3_600_000)
RECEIPT_SHIFT_MS = 1_800_000

# Events of the given table arrive in the order of their ids.
ARRIVAL = "event_id"

_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.by_minute(playback_events(spark, sf_dir))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.accepted_events(validate.with_verdict(raw_batches(spark, sf_dir)))


# -- typed events and projections -----------------------------------------------


@query
def typed_events(spark, sf_dir):
    return playback_events(spark, sf_dir)


@query
def minute_key(spark, sf_dir):
    ms = F.col("timestamp_ms")
    return playback_events(spark, sf_dir).select(
        "event_id",
        M.minute_of(ms).alias("minute_ms"),
        M.iso_minute(ms).alias("minute"),
        *M.calendar(ms),
        M.label_to_ms(M.iso_minute(ms)).alias("label_ms"),
    )


@query
def time_domain(spark, sf_dir):
    ms = F.col("timestamp_ms")
    # Moved so that about half of the events fall before the first minute.
    moved = ms - F.lit(1_705_500_000_000)
    return playback_events(spark, sf_dir).select(
        "event_id",
        M.in_time_domain(ms).alias("in_domain"),
        M.in_time_domain(moved).alias("moved_in_domain"),
        M.minute_of(moved).alias("moved_minute_ms"),
    )


@query
def negative_samples(spark, sf_dir):
    fields = {
        "startup_time_ms": "startup_complete",
        "buffer_duration_ms": "buffer_end",
        "bitrate_kbps": "bitrate_change",
        "watch_time_ms": "playback_end",
    }
    aggs = []
    for field, kind in fields.items():
        aggs += [
            F.count(field).alias(f"{field}_present"),
            F.count_if(F.col(field) < 0).alias(f"{field}_negative"),
            F.expr(f"count({usable(kind, field)}) AS {field}_usable"),
        ]
    return playback_events(spark, sf_dir).agg(*aggs)


# -- rollups ----------------------------------------------------------------------


@query
def totals_direct(spark, sf_dir):
    return rollups.totals_direct(playback_events(spark, sf_dir))


@query
def minute_rollup(spark, sf_dir):
    means = derived("startup_avg_ms", "buffer_avg_ms", "watch_time_min", "bitrate_avg_kbps")
    return timeseries.with_label(_minutes(spark, sf_dir)).select(
        "minute_ms", "minute", *COUNTERS, *means
    )


@query
def by_player(spark, sf_dir):
    return PlaybackMetrics.from_events(playback_events(spark, sf_dir)).by_player()


@query
def by_device(spark, sf_dir):
    return PlaybackMetrics.from_events(playback_events(spark, sf_dir)).by_device()


@query
def multi_rollup(spark, sf_dir):
    return rollups.multi_rollup(playback_events(spark, sf_dir))


@query
def totals(spark, sf_dir):
    return rollups.totals(_minutes(spark, sf_dir))


@query
def minute_count(spark, sf_dir):
    ms = M.minute_of(F.col("timestamp_ms"))
    return rollups.minute_count(playback_events(spark, sf_dir).select(ms.alias("minute_ms")))


@query
def overall(spark, sf_dir):
    return PlaybackMetrics.from_events(playback_events(spark, sf_dir)).overall()


@query
def merge_partials(spark, sf_dir):
    from playtally.functions.counters import counter_aggs

    # Partials as separate writers would leave them: one per 500 events.
    writer = F.col("event_id") - F.pmod(F.col("event_id"), F.lit(500))
    partials = (
        playback_events(spark, sf_dir)
        .groupBy(writer.alias("writer"), M.minute_of(F.col("timestamp_ms")).alias("minute_ms"))
        .agg(*counter_aggs())
    )
    return rollups.merge(partials, ("minute_ms",))


# -- label cap ----------------------------------------------------------------------


@query
def capped_players(spark, sf_dir):
    events = wide_labels(playback_events(spark, sf_dir))
    return as_metrics(labels.capped_rollup(events, "player", ARRIVAL, PLAYER_CAP), ("name",))


@query
def capped_devices(spark, sf_dir):
    events = playback_events(spark, sf_dir)
    return as_metrics(labels.capped_rollup(events, "device", ARRIVAL, DEVICE_CAP), ("name",))


@query
def capped_reserved(spark, sf_dir):
    events = wide_labels(playback_events(spark, sf_dir))
    own = F.when(F.col("device") == "device1", F.lit(OVERFLOW_LABEL)).otherwise(F.col("player"))
    return as_metrics(
        labels.capped_rollup(events.withColumn("player", own), "player", ARRIVAL, PLAYER_CAP),
        ("name",),
    )


@query
def capped_unbroadcast(spark, sf_dir):
    options = RollupOptions(max_segments=PLAYER_CAP.max_segments, broadcast_segments=0)
    events = wide_labels(playback_events(spark, sf_dir))
    return as_metrics(labels.capped_rollup(events, "player", ARRIVAL, options), ("name",))


@query
def segment_overflows(spark, sf_dir):
    events = wide_labels(playback_events(spark, sf_dir))
    return labels.segment_overflows(events, ARRIVAL, DEVICE_CAP)


# -- time series ----------------------------------------------------------------------


@query
def minute_point(spark, sf_dir):
    events = playback_events(spark, sf_dir, M.minute_floor(POINT_MS), M.minute_floor(POINT_MS) + 59_999)
    return PlaybackMetrics.from_events(events).minute(POINT_MS)


@query
def live_recent(spark, sf_dir):
    return PlaybackMetrics.from_events(playback_events(spark, sf_dir)).live(LIVE_BUCKETS)


@query
def live_clamped(spark, sf_dir):
    return PlaybackMetrics.from_events(playback_events(spark, sf_dir), limits=CLAMP).live("999999999")


@query
def minute_range(spark, sf_dir):
    low, high = RANGE_MS
    events = playback_events(spark, sf_dir, M.minute_floor(low), M.minute_floor(high) + 59_999)
    return PlaybackMetrics.from_events(events).range(low, high)


@query
def range_requests(spark, sf_dir):
    """A range around every event, some of them asked for wrongly."""
    events = playback_events(spark, sf_dir)
    case = "event_id % 11"
    low = "CAST(timestamp_ms - (event_id % 90) * 60000 AS STRING)"
    high = "CAST(timestamp_ms + (event_id % 1500) * 60000 AS STRING)"
    requests = events.selectExpr(
        "event_id AS request_id",
        f"CASE {case} WHEN 3 THEN concat('x', {low}) WHEN 5 THEN NULL WHEN 7 THEN concat({high}, '0') WHEN 9 THEN '-1' ELSE {low} END AS from_ms",
        f"CASE {case} WHEN 4 THEN '99999999999999999999' WHEN 8 THEN '1' ELSE {high} END AS to_ms",
    )
    return timeseries.range_requests(rollups.by_minute(events), requests)


@query
def fill_gaps(spark, sf_dir):
    points = timeseries.recent(_minutes(spark, sf_dir), FILL_BUCKETS)
    return timeseries.minute_metrics(timeseries.fill_gaps(points, limit=QueryLimits().gap_fill_minutes))


@query
def window_totals(spark, sf_dir):
    return timeseries.window_totals(timeseries.recent(_minutes(spark, sf_dir), FILL_BUCKETS))


@query
def kpi_panel(spark, sf_dir):
    return PlaybackMetrics.from_events(playback_events(spark, sf_dir)).kpi_panels()


@query
def segments_ranked(spark, sf_dir):
    return PlaybackMetrics.from_events(playback_events(spark, sf_dir)).ranked(
        "player", "watch_time_min"
    )


@query
def chart_series(spark, sf_dir):
    return timeseries.chart_series(_minutes(spark, sf_dir), "startup_avg_ms")


@query
def chart_all(spark, sf_dir):
    return timeseries.chart_all(_minutes(spark, sf_dir))


# -- gauge, rates, sessions -------------------------------------------------------------


@query
def active_sessions(spark, sf_dir):
    return gauge.active_sessions(playback_events(spark, sf_dir)).drop("last")


@query
def active_sessions_arrival(spark, sf_dir):
    # Batches of fifty share a receipt time, so batch and position decide.
    events = playback_events(spark, sf_dir).selectExpr(
        "*",
        "timestamp_ms - pmod(timestamp_ms, 86400000L) AS ingest_time_ms",
        "CAST(1000000 + event_id % 1000 AS STRING) AS batch_id",
        "CAST(event_id div 1000 AS INT) AS idx",
    )
    return gauge.active_sessions(events, gauge.ARRIVAL).drop("last")


@query
def counter_rate(spark, sf_dir):
    samples = playback_events(spark, sf_dir).select(
        F.col("device").alias("series"),
        F.col("timestamp_ms").alias("ts_ms"),
        "event_id",
        # A counter that also goes back, as after a restart.
        F.pmod(F.col("event_id") * 7, F.lit(1000)).alias("value"),
    )
    return rates.counter_rate(samples, tie="event_id")


@query
def events_per_sec(spark, sf_dir):
    return rates.events_per_sec(_minutes(spark, sf_dir))


@query
def status_row(spark, sf_dir):
    return PlaybackMetrics.from_events(playback_events(spark, sf_dir)).status()


@query
def session_audit(spark, sf_dir):
    return sessions.session_audit(playback_events(spark, sf_dir))


# -- raw batches --------------------------------------------------------------------------


@query
def verdicts(spark, sf_dir):
    return validate.verdicts(raw_batches(spark, sf_dir))


@query
def verdicts_tight(spark, sf_dir):
    batches = raw_batches(spark, sf_dir, shape_defects=True)
    return validate.verdicts(batches, TIGHT).drop("message")


@query
def scan_shape(spark, sf_dir):
    return validate.scan_shape(raw_batches(spark, sf_dir, shape_defects=True))


@query
def reject_reasons(spark, sf_dir):
    judged = validate.verdicts(raw_batches(spark, sf_dir))
    return judged.groupBy("status", "reason").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("first_idx").cast("bigint").alias("sum_first_idx"),
    )


@query
def verdict_counts(spark, sf_dir):
    return validate.verdict_counts(validate.with_verdict(raw_batches(spark, sf_dir)))


@query
def accepted_events(spark, sf_dir):
    return _accepted(spark, sf_dir)


@query
def ingest_accept(spark, sf_dir):
    return rollups.by_minute(_accepted(spark, sf_dir))


@query
def ts_default(spark, sf_dir):
    return (
        _accepted(spark, sf_dir)
        .where(F.col("timestamp_ms") == F.col("ingest_time_ms"))
        .select("batch_id", "idx", "event_type", "timestamp_ms")
    )


@query
def freshness_filter(spark, sf_dir):
    # Receipt moved back half an hour: now there are early events as well.
    moved = _accepted(spark, sf_dir).withColumn(
        "ingest_time_ms", F.col("ingest_time_ms") - F.lit(RECEIPT_SHIFT_MS)
    )
    return validate.within_freshness(moved, SHORT_WINDOW).select("batch_id", "idx", "timestamp_ms")


@query
def parse_events(spark, sf_dir):
    return parse.parse_batches(raw_batches(spark, sf_dir))


@query
def parse_counts(spark, sf_dir):
    return parse.parse_counts(parse.parse_batches(raw_batches(spark, sf_dir)))


@query
def duplicate_batches(spark, sf_dir):
    batches = raw_batches(spark, sf_dir)
    resent = batches.unionByName(batches)
    return rollups.by_minute(validate.accepted_events(validate.with_verdict(resent)))


@query
def ingest_stats(spark, sf_dir):
    return rates.ingest_stats(validate.with_verdict(raw_batches(spark, sf_dir)))


def _spool(spark, sf_dir):
    n = F.col("batch_id").cast("bigint")
    name = (
        F.when(n % 9 == 0, F.concat(F.lit("batch-"), F.lpad("batch_id", 8, "0"), F.lit(".json")))
        .when(n % 9 == 4, F.concat(F.lit("notes-"), "batch_id", F.lit(".txt")))
        .when(n % 9 == 7, F.concat(F.lit("batch-x"), "batch_id", F.lit(".json")))
        .otherwise(F.concat(F.lit("batch-"), "batch_id", F.lit(".json")))
    )
    return raw_batches(spark, sf_dir).select(name.alias("file_name"), "body")


@query
def backfill_batches(spark, sf_dir):
    return raw.backfill(_spool(spark, sf_dir)).select(
        F.col("spool_index").cast("bigint").alias("spool_index"),
        "file_name",
        F.octet_length("body").alias("n_bytes"),
        "usable",
    )


@query
def backlog_retain(spark, sf_dir):
    numbered = raw.backfill(_spool(spark, sf_dir))
    kept = raw.retain_newest(numbered, "spool_index", BACKLOG)
    return kept.select(F.col("spool_index").cast("bigint").alias("spool_index"), "file_name")


# -- snapshots ----------------------------------------------------------------------------


@query
def snapshot_roundtrip(spark, sf_dir):
    rows = rollups.multi_rollup(playback_events(spark, sf_dir))
    return snapshot.document_rows(snapshot.check_documents(snapshot.to_documents(rows)))


def _damaged(documents: DataFrame) -> DataFrame:
    day = F.regexp_extract("doc_id", r"^minutes-\d+-\d+-(\d+)$", 1).try_cast("int")
    kind = F.coalesce(day % 8, F.lit(0))
    body = F.col("body")
    swap = lambda old, new: F.replace(body, F.lit(old), F.lit(new))
    return documents.withColumn(
        "body",
        F.when(kind == 1, swap('"version":2', '"version":3'))
        .when(kind == 2, swap('"total_views"', '"views"'))
        .when(kind == 3, swap('"buffer_samples"', '"stalls"'))
        .when(kind == 4, swap('"h":', '"hour":'))
        .when(kind == 5, F.substring(body, F.lit(1), F.length(body) - 1))
        .when(kind == 6, swap('"minutes":[', '"minutes":"","old":['))
        .when(kind == 7, swap('"version":2', '"version":"2"'))
        .otherwise(body),
    )


def _documents(rows: DataFrame) -> DataFrame:
    # A unit for each day of the month; labels make one of their own.
    day = F.regexp_extract("doc_id", r"^minutes-\d+-\d+-(\d+)$", 1)
    return snapshot.to_documents(rows, label_buckets=1).withColumn("snapshot_id", day)


@query
def snapshot_refused(spark, sf_dir):
    # Days sixteen apart make a snapshot. Only documents of the first sixteen
    # days are damaged; those sixteen days later are refused along with them.
    rows = rollups.multi_rollup(playback_events(spark, sf_dir))
    day = F.coalesce(F.regexp_extract("doc_id", r"^minutes-\d+-\d+-(\d+)$", 1).try_cast("int"), F.lit(0))
    documents = snapshot.to_documents(rows, label_buckets=1).withColumn("snapshot_id", day % 16)
    early = day <= 16
    mixed = _damaged(documents).where(early).unionByName(documents.where(~early))
    return snapshot.document_rows(snapshot.check_documents(mixed))


@query
def snapshot_validate(spark, sf_dir):
    rows = rollups.multi_rollup(playback_events(spark, sf_dir))
    checked = snapshot.check_documents(_damaged(_documents(rows)))
    return checked.select("doc_id", "version", "reason")


@query
def snapshot_load_json(spark, sf_dir):
    rows = rollups.multi_rollup(playback_events(spark, sf_dir))
    checked = snapshot.check_documents(_damaged(_documents(rows)))
    return snapshot.document_rows(checked)


@query
def snapshot_migrate_v1(spark, sf_dir):
    rows = rollups.multi_rollup(playback_events(spark, sf_dir))
    old = snapshot.check_documents(snapshot.to_documents(rows, version=1))
    segments = rollups.segments_of(snapshot.document_rows(old), "device")
    return as_metrics(segments, ("name",))


@query
def restore_additive(spark, sf_dir):
    rows = rollups.multi_rollup(playback_events(spark, sf_dir))
    loaded = snapshot.document_rows(snapshot.check_documents(snapshot.to_documents(rows)))
    return snapshot.restore(rows, loaded)


@query
def restore_capped(spark, sf_dir):
    events = playback_events(spark, sf_dir)
    restored = rollups.by_label(events, "player")
    capped = labels.capped_rollup(
        wide_labels(events), "player", ARRIVAL, RESTORE_CAP, restored=restored
    )
    return as_metrics(capped, ("name",))


@query
def restore_store_capped(spark, sf_dir):
    """A history restored under a cap, an epoch of live labels, and a restore of them: rows of both dimensions."""
    events = playback_events(spark, sf_dir)
    live = wide_labels(events).withColumns(
        {"ingest_time_ms": F.lit(0).cast("bigint"), "batch_id": F.lit(""), "idx": F.col(ARRIVAL)}
    )
    root = scratch(spark, "restored")
    store = RollupStore(spark, root)
    store.restore(snapshot.to_documents(rollups.multi_rollup(events)), STORE_CAP)
    slots = LabelSlots(spark, f"{root}/label_slots", STORE_CAP, store)
    store.write_epoch(rollups.multi_rollup(slots.assign(live, 0)), 0)
    store.restore(snapshot.to_documents(rollups.multi_rollup(live)), STORE_CAP)
    return _both_dimensions(store)


def _both_dimensions(store: RollupStore) -> DataFrame:
    parts = [
        as_metrics(store.segments(d), ("name",)).withColumn("dimension", F.lit(d)) for d in rollups.DIMENSIONS
    ]
    return parts[0].unionByName(parts[1])


def _ingested(spark, sf_dir) -> RollupStore:
    """All batches ingested in epochs, one of them twice, with a compaction between."""
    root = scratch(spark, "ingested")
    writer = EpochWriter(spark, root, LEDGER_CAP)
    batches = raw_batches(spark, sf_dir)
    for epoch in (0, 1, 1, 2):
        own = batches.where(F.col("batch_id").cast("bigint") % EPOCHS == epoch)
        writer.write(validate.with_verdict(own), epoch)
        if epoch == 0:
            writer.store.compact(0)
    return writer.store


@query
def ingest_ledger(spark, sf_dir):
    return _ingested(spark, sf_dir).ledger()


@query
def ingest_quarantine(spark, sf_dir):
    """What ingest refused: with the events in the ledger, all that came in."""
    return _ingested(spark, sf_dir).quarantine().select(
        "batch_id", "idx", "reason", "message", F.octet_length("raw").alias("n_bytes"), "epoch_id"
    )


@query
def store_recent(spark, sf_dir):
    """The latest buckets of a stored history, from the newest days alone."""
    store = RollupStore(spark, scratch(spark, "recent"))
    store.write_snapshot(rollups.multi_rollup(playback_events(spark, sf_dir)), 0)
    return PlaybackMetrics.from_store(store).live(LIVE_BUCKETS)


# -- documents ------------------------------------------------------------------------------


def _ddl(struct) -> str:
    return struct.simpleString()


@query
def doc_overall(spark, sf_dir):
    doc = PlaybackMetrics.from_events(playback_events(spark, sf_dir)).overall_document()
    shape = f"struct<totals:{_ddl(METRICS)},minutes_tracked:bigint>"
    return doc.select(F.from_json("doc", shape).alias("d")).select("d.totals.*", "d.minutes_tracked")


def _minute_entries(doc: DataFrame, *bounds: str) -> DataFrame:
    head = "".join(f"`{b}`:string," for b in bounds)
    shape = f"struct<{head}minutes:array<struct<minute:string,metrics:{_ddl(MINUTE_METRICS)}>>>"
    return (
        doc.select(F.from_json("doc", shape).alias("d"))
        .select(*[F.col(f"d.{b}").alias(f"{b}_minute") for b in bounds], F.posexplode("d.minutes").alias("pos", "p"))
        .select("pos", *[f"{b}_minute" for b in bounds], "p.minute", "p.metrics.*")
    )


@query
def doc_live(spark, sf_dir):
    metrics = PlaybackMetrics.from_events(playback_events(spark, sf_dir))
    return _minute_entries(metrics.live_document(LIVE_BUCKETS))


@query
def doc_range(spark, sf_dir):
    low, high = RANGE_MS
    events = playback_events(spark, sf_dir, M.minute_floor(low), M.minute_floor(high) + 59_999)
    return _minute_entries(PlaybackMetrics.from_events(events).range_document(low, high), "from", "to")


@query
def doc_players(spark, sf_dir):
    doc = PlaybackMetrics.from_events(playback_events(spark, sf_dir), ARRIVAL).players_document()
    shape = f"struct<players:array<struct<name:string,metrics:{_ddl(METRICS)}>>>"
    return (
        doc.select(F.from_json("doc", shape).alias("d"))
        .select(F.posexplode("d.players").alias("pos", "p"))
        .select("pos", "p.name", "p.metrics.*")
    )
