"""Limits and switches, as immutable values."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults that decide which input is accepted.
MIB = 1024 * 1024
DAY_MS = 86_400_000
MINUTE_MS = 60_000


@dataclass(frozen=True)
class IngestLimits:
    """Bounds a batch must meet before any of its events is counted."""

    max_body_bytes: int = 8 * MIB
    max_structural_tokens: int = 250_000
    max_json_depth: int = 32
    max_events_per_batch: int = 10_000
    max_lateness_ms: int = 7 * DAY_MS
    max_future_skew_ms: int = 5 * MINUTE_MS
    max_label_bytes: int = 128
    max_startup_time_ms: int = 600_000
    max_buffer_duration_ms: int = 3_600_000
    max_bitrate_kbps: int = 1_000_000
    max_watch_time_ms: int = 86_400_000
    require_event_type: bool = True

    @property
    def numeric_ranges(self) -> tuple[tuple[str, int], ...]:
        """(field, largest accepted value), in the order they are checked."""
        return (
            ("startup_time_ms", self.max_startup_time_ms),
            ("buffer_duration_ms", self.max_buffer_duration_ms),
            ("bitrate_kbps", self.max_bitrate_kbps),
            ("watch_time_ms", self.max_watch_time_ms),
        )


@dataclass(frozen=True)
class RollupOptions:
    """How many labels of one dimension keep a row of their own."""

    max_segments: int = 1000
    # Up to this many tracked labels are broadcast (128-byte names: ~13 MB).
    # Beyond it the labels are folded after the first aggregation instead.
    broadcast_segments: int = 100_000


@dataclass(frozen=True)
class QueryLimits:
    """Size of the answers the read API gives."""

    max_minutes: int = 1440
    default_minutes: int = 15
    gap_fill_minutes: int = 2000
