"""The read API: every answer a dashboard asks for, as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from playtally.functions.counters import as_metrics
from playtally.operators import gauge, labels, rates, rollups, timeseries
from playtally.options import QueryLimits, RollupOptions
from playtally.sources import documents
from playtally.sources.store import RollupStore


class PlaybackMetrics:
    """Answers from minute buckets and capped label rollups.

    ``minutes`` gives the buckets of an optional inclusive range, so that a
    range read touches only what it asks for. ``recent`` gives buckets that hold
    the latest N, where there is a shorter way to them than through all.
    """

    def __init__(
        self,
        minutes: Callable[..., DataFrame],
        segments: Callable[[str], DataFrame],
        sessions: Callable[[], DataFrame] | None = None,
        limits: QueryLimits = QueryLimits(),
        capped: bool = True,
        recent: Callable[[int], DataFrame] | None = None,
    ):
        self._minutes = minutes
        self._segments = segments
        self._sessions = sessions
        self.limits = limits
        self.capped = capped
        self._recent = recent or (lambda n: minutes())

    @classmethod
    def from_events(
        cls,
        events: DataFrame,
        arrival=None,
        options: RollupOptions = RollupOptions(),
        limits: QueryLimits = QueryLimits(),
    ) -> PlaybackMetrics:
        """Straight from typed events, rolled up on demand. With an arrival
        column labels are capped, without one every label keeps its row."""

        def minutes(from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
            if from_ms is None or to_ms is None:
                return rollups.by_minute(events)
            return rollups.by_minute(
                timeseries.within_minutes(events, from_ms, to_ms, "timestamp_ms")
            )

        def segments(dimension: str) -> DataFrame:
            if arrival is None:
                return rollups.by_label(events, dimension)
            return labels.capped_rollup(events, dimension, arrival, options)

        return cls(
            minutes,
            segments,
            lambda: gauge.current_sessions(gauge.active_sessions(events)),
            limits,
            capped=arrival is not None,
        )

    @classmethod
    def from_store(
        cls,
        store: RollupStore,
        active_sessions: int = 0,
        limits: QueryLimits = QueryLimits(),
        options: RollupOptions = RollupOptions(),
    ) -> PlaybackMetrics:
        """From stored rollups, without touching events.

        A store whose rows came by ingest and restore is capped already; one that
        was written with more labels shows the first ``max_segments`` by name, so
        that a document of all labels has a bound whatever is stored.
        """
        current = lambda: store.spark.createDataFrame(
            [(active_sessions,)], "active_sessions bigint"
        )
        segments = lambda dimension: labels.capped_rows(store.segments(dimension), options)
        return cls(store.minutes, segments, current, limits, recent=store.recent)

    def overall(self) -> DataFrame:
        return as_metrics(rollups.overall(self._minutes()), ("minutes_tracked",))

    def minute(self, ms: int) -> DataFrame:
        """One minute; no row if it has no bucket, which is not all zeroes."""
        return timeseries.minute_metrics(self._minutes(ms, ms))

    def live(self, minutes: object = None) -> DataFrame:
        n = timeseries.live_minutes(minutes, self.limits)
        return timeseries.minute_metrics(timeseries.recent(self._recent(n), n))

    def range(self, from_ms: object, to_ms: object) -> DataFrame:
        low, high = timeseries.range_bounds(from_ms, to_ms, self.limits)
        return timeseries.range_metrics(self._minutes(low, high), low, high)

    def by_player(self) -> DataFrame:
        return as_metrics(self._segments("player"), ("name",)).orderBy("name")

    def by_device(self) -> DataFrame:
        return as_metrics(self._segments("device"), ("name",)).orderBy("name")

    def ranked(self, dimension: str, metric: str) -> DataFrame:
        return timeseries.rank_segments(self._segments(dimension), metric)

    def kpi_panel(self, window: str = "15m") -> DataFrame:
        n = timeseries.PRESET_WINDOWS[window]
        return timeseries.kpi_panel(self._recent(n), n, self.limits.gap_fill_minutes)

    def kpi_panels(self) -> DataFrame:
        """The panel of every preset window."""
        latest = self._recent(max(timeseries.PRESET_WINDOWS.values()))
        return timeseries.kpi_panels(latest, timeseries.PRESET_WINDOWS, self.limits.gap_fill_minutes)

    def status(self) -> DataFrame:
        if self._sessions is None:
            raise ValueError("no session gauge is attached")
        return rates.status_row(self._minutes(), self._sessions())

    # -- the same as JSON documents ----------------------------------------

    def overall_document(self) -> DataFrame:
        return documents.overall_document(self._minutes())

    def live_document(self, minutes: object = None) -> DataFrame:
        n = timeseries.live_minutes(minutes, self.limits)
        return documents.live_document(timeseries.recent(self._recent(n), n))

    def range_document(self, from_ms: object, to_ms: object) -> DataFrame:
        low, high = timeseries.range_bounds(from_ms, to_ms, self.limits)
        return documents.range_document(
            timeseries.span(self._minutes(low, high), low, high), low, high
        )

    def _segments_document(self, dimension: str, section: str) -> DataFrame:
        if not self.capped:
            raise ValueError("one document holds all labels: give an arrival to cap them")
        return documents.segments_document(self._segments(dimension), section)

    def players_document(self) -> DataFrame:
        return self._segments_document("player", "players")

    def devices_document(self) -> DataFrame:
        return self._segments_document("device", "devices")

    def status_document(self) -> DataFrame:
        return documents.status_document(self.status())
