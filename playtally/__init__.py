"""Playback quality-of-experience analytics as DataFrame transformations.

Layers, bottom up:

* ``functions``  column expressions (JSON shape, minutes, counters)
* ``sources``    readers, writers and the adapter for the test tables
* ``operators``  DataFrame -> DataFrame building blocks
* ``plans``      the read API a dashboard or report calls
* ``streaming``  the same operators under Structured Streaming
"""

from playtally.options import IngestLimits, QueryLimits, RollupOptions
from playtally.session import configure, local_session

__all__ = ["IngestLimits", "QueryLimits", "RollupOptions", "configure", "local_session"]
