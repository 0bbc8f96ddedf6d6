"""Stored rollups: partials per epoch, and published snapshots.

Layout below a root path::

    partials/epoch_id=<n>/day=<yyyy-MM-dd | ->/...   one write per micro-batch
    ledger/epoch_id=<n>/...                          its ingest counters
    quarantine/epoch_id=<n>/...                      what it refused, and why
    snapshots/snapshot_id=<n>/day=.../...            the days that snapshot changed
    restores/snapshot_id=<n>/...                     rows of restored documents, checked
    published/                                       one tiny file per publication

A snapshot counts once it is published. Publishing appends a single file by
rename, so a reader sees either the former or the new snapshot, and a writer
that dies halfway leaves data nobody refers to. A publication names for each
day the snapshot that holds it: compaction and restore write the days they
touch, and all others stay where they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtally.functions.minutes import day_of
from playtally.operators import rollups, snapshot
from playtally.operators.timeseries import within_minutes
from playtally.options import DAY_MS, RollupOptions
from playtally.schema import LEDGER, OVERFLOW_LABEL, PARTIALS, QUARANTINE

_DAY = T.StructType(
    [
        T.StructField("day", T.StringType(), False),
        T.StructField("snapshot_id", T.LongType(), False),
        T.StructField("minutes", T.LongType(), False),
    ]
)
_PUBLISHED = T.StructType(
    [
        T.StructField("snapshot_id", T.LongType(), False),
        T.StructField("through_epoch", T.LongType(), False),
        T.StructField("days", T.ArrayType(_DAY, False), False),
        T.StructField("ledger", LEDGER, False),
    ]
)
_NO_DAY = "-"

# Ranges up to this many days are read by naming the days' folders.
_LISTED_DAYS = 31


def only_missing_path(error: AnalysisException) -> None:
    """Pass over a path that does not exist yet; raise anything else."""
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error


@dataclass(frozen=True)
class Publication:
    """What readers see: the snapshot of every day, the epochs it covers and their summed ledger."""

    snapshot_id: int = -1
    through_epoch: int = -1
    #: day -> (snapshot that holds it, minute buckets in it)
    days: dict[str, tuple[int, int]] = field(default_factory=dict)
    ledger: tuple[int, ...] = (0,) * len(LEDGER)


class RollupStore:
    """Minute, player and device counters under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    # -- partials ---------------------------------------------------------

    def write_epoch(self, rows: DataFrame, epoch_id: int) -> None:
        """Write the rollup of one micro-batch. Writing an epoch again, as
        after a lost driver, replaces it and so counts nothing twice."""
        _by_day(rows).write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).partitionBy("day").parquet(f"{self.path}/partials/epoch_id={epoch_id}")

    def _read(self, kind: str, key: str, inside: str = "") -> DataFrame:
        """Rows below ``kind``, or of the folders ``inside`` matches there.

        A narrower pattern lists fewer folders; no match means no rows.
        """
        schema = T.StructType(
            [
                *PARTIALS.fields,
                T.StructField(key, T.LongType()),
                T.StructField("day", T.StringType()),
            ]
        )
        base = f"{self.path}/{kind}"
        try:
            return (
                self.spark.read.schema(schema).option("basePath", base).parquet(f"{base}{inside}")
            )
        except AnalysisException as error:
            only_missing_path(error)
            return self.spark.createDataFrame([], schema)

    def _publications(self, newest: int) -> list[Publication]:
        try:
            rows = self.spark.read.schema(_PUBLISHED).parquet(f"{self.path}/published")
        except AnalysisException as error:
            only_missing_path(error)
            return []
        top = rows.orderBy(F.col("snapshot_id").desc()).limit(newest).collect()
        return [
            Publication(
                r["snapshot_id"],
                r["through_epoch"],
                {d["day"]: (d["snapshot_id"], d["minutes"]) for d in r["days"]},
                tuple(r["ledger"]),
            )
            for r in top
        ]

    def _current(self) -> Publication:
        return (self._publications(1) or [Publication()])[0]

    def published(self) -> tuple[int, int]:
        """(snapshot id, last epoch it covers); (-1, -1) before the first."""
        current = self._current()
        return current.snapshot_id, current.through_epoch

    def _snapshot_rows(self, publication: Publication, days: set[str] | None = None) -> DataFrame:
        """Rows of a published snapshot; of the given days only their folders are listed."""
        base = f"{self.path}/snapshots"
        paths = [
            f"{base}/snapshot_id={held}/day={day}"
            for day, (held, _) in sorted(publication.days.items())
            if days is None or day in days
        ]
        schema = T.StructType([*PARTIALS.fields, T.StructField("day", T.StringType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)

    def _later(self, publication: Publication, days: set[str] | None = None) -> DataFrame:
        """Partials that the publication does not cover."""
        inside = "" if days is None else f"/epoch_id=*/day={{{','.join(sorted(days))}}}"
        later = self._read("partials", "epoch_id", inside)
        return later.where(F.col("epoch_id") > publication.through_epoch).select(*PARTIALS.names, "day")

    def _partial_days(self, after: int, through: int | None = None) -> dict[str, int]:
        """Days of the partials of epochs after one, up to another, and the last such epoch of each; by listing alone."""
        days: dict[str, int] = {}
        for path in self._read("partials", "epoch_id").inputFiles():
            found = re.search(r"/epoch_id=(\d+)/day=([^/]+)/", path)
            if found and after < (epoch := int(found[1])) and (through is None or epoch <= through):
                days[found[2]] = max(epoch, days.get(found[2], -1))
        return days

    def _all(self, days: set[str] | None = None) -> DataFrame:
        current = self._current()
        return self._snapshot_rows(current, days).unionByName(self._later(current, days))

    def rows(self, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
        """All counters, unmerged. Bounds prune days and row groups; with
        bounds only minute rows are given, since labels have no time."""
        if from_ms is None or to_ms is None:
            return self._all().drop("day")
        first, last = from_ms // DAY_MS, to_ms // DAY_MS
        named = [_day_name(d) for d in (first, last)]
        # A short range names its days, so that only those are listed.
        days = None
        if 0 <= last - first < _LISTED_DAYS:
            days = {_day_name(d) for d in range(first, last + 1)}
        rows = self._all(days).where(F.col("day").between(*named))
        return within_minutes(rows, from_ms, to_ms, "minute_ms").drop("day")

    def minutes(self, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
        """Merged minute buckets."""
        rows = self.rows(from_ms, to_ms).where(F.col("grain") == "minute")
        return rollups.merge(rows, ("minute_ms",))

    def recent(self, n: int) -> DataFrame:
        """Merged minute buckets that hold the latest ``n``, and perhaps some before them.

        Days are taken newest first until they are sure to have ``n`` buckets: a
        publication knows how many each of its days has, and later partials only
        add. No older day is opened, and choosing takes no job over the rows.
        """
        current = self._current()
        sure = {d: minutes for d, (_, minutes) in current.days.items()}
        for day in self._partial_days(current.through_epoch):
            sure[day] = max(sure.get(day, 0), 1)
        sure.pop(_NO_DAY, None)
        days, held = set(), 0
        for day in sorted(sure, reverse=True):
            if held >= n:
                break
            days.add(day)
            held += sure[day]
        rows = self._snapshot_rows(current, days).unionByName(self._later(current, days or {_NO_DAY}))
        return rollups.merge(rows.where(F.col("grain") == "minute"), ("minute_ms",))

    def segments(self, dimension: str) -> DataFrame:
        """Merged rows of one label dimension."""
        rows = self._all({_NO_DAY}).where((F.col("day") == _NO_DAY) & (F.col("grain") == dimension))
        return rollups.merge(rows, ("name",))

    def published_names(self) -> DataFrame:
        """(dimension, name) of the labels that have a row in the published snapshot, the reserved one apart."""
        return _names(self._snapshot_rows(self._current(), {_NO_DAY}))

    # -- ledger and quarantine --------------------------------------------------

    def write_ledger(self, counts: dict[str, int], epoch_id: int) -> None:
        """Ingest counters of one micro-batch; writing an epoch again replaces it."""
        row = self.spark.createDataFrame([tuple(counts[c] for c in LEDGER.names)], LEDGER)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/epoch_id={epoch_id}")

    def _ledger_rows(self, after: int, through: int | None = None) -> DataFrame:
        schema = T.StructType([*LEDGER.fields, T.StructField("epoch_id", T.LongType())])
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/ledger")
        except AnalysisException as error:
            only_missing_path(error)
            rows = self.spark.createDataFrame([], schema)
        rows = rows.where(F.col("epoch_id") > after)
        return rows if through is None else rows.where(F.col("epoch_id") <= through)

    def ledger(self) -> DataFrame:
        """Ingest counters over all epochs, one row; restores count among ``segment_overflows``."""
        current = self._current()
        before = self.spark.createDataFrame([current.ledger], LEDGER)
        rows = self._ledger_rows(current.through_epoch).select(*LEDGER.names).unionByName(before)
        return rows.agg(*[F.sum(c).alias(c) for c in LEDGER.names])

    def write_quarantine(self, rows: DataFrame, epoch_id: int) -> None:
        """What a micro-batch refused; writing an epoch again replaces it."""
        rows.write.mode("overwrite").parquet(f"{self.path}/quarantine/epoch_id={epoch_id}")

    def quarantine(self) -> DataFrame:
        """(batch_id, ingest_time_ms, idx, reason, message, raw, epoch_id) of refused batches (no ``idx``) and elements."""
        schema = T.StructType([*QUARANTINE.fields, T.StructField("epoch_id", T.LongType())])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/quarantine")
        except AnalysisException as error:
            only_missing_path(error)
            return self.spark.createDataFrame([], schema)

    # -- snapshots --------------------------------------------------------

    def write_snapshot(self, rows: DataFrame, snapshot_id: int, through_epoch: int = -1) -> None:
        """Write a complete snapshot and then publish it.

        Until the last line the previous snapshot is the one that counts.
        """
        current = self._current()
        if snapshot_id <= current.snapshot_id:
            raise ValueError(f"snapshot {snapshot_id} is not newer than {current.snapshot_id}")
        self._publish(rows, snapshot_id, through_epoch, {}, current.ledger)

    def _publish(
        self,
        rows: DataFrame | None,
        snapshot_id: int,
        through_epoch: int,
        kept: dict[str, tuple[int, int]],
        ledger: tuple[int, ...],
    ) -> None:
        """Write the days of ``rows`` as a snapshot and publish them over those ``kept``."""
        days = dict(kept)
        if rows is not None:
            target = f"{self.path}/snapshots/snapshot_id={snapshot_id}"
            _by_day(rollups.merge_multi(rows)).write.mode("overwrite").option(
                "partitionOverwriteMode", "static"
            ).partitionBy("day").parquet(target)
            layout = T.StructType([*PARTIALS.fields, T.StructField("day", T.StringType())])
            written = self.spark.read.schema(layout).parquet(target)
            # One row a day.
            for r in written.groupBy("day").agg(F.count("minute_ms").alias("n")).collect():
                days[r["day"]] = (snapshot_id, r["n"])
        row = (snapshot_id, through_epoch, [(d, *held) for d, held in sorted(days.items())], ledger)
        self.spark.createDataFrame([row], _PUBLISHED).coalesce(1).write.mode("append").parquet(
            f"{self.path}/published"
        )

    def read_snapshot(self) -> DataFrame:
        """Rows of the published snapshot."""
        current = self._current()
        if current.snapshot_id < 0:
            raise ValueError(f"no snapshot is published under {self.path}")
        return self._snapshot_rows(current).select(*PARTIALS.names)

    def compact(self, through_epoch: int) -> int:
        """Fold everything up to an epoch into a new published snapshot.

        Only days that the epochs touch are read and written; the others stay
        with the snapshot that holds them.
        """
        current = self._current()
        if through_epoch <= current.through_epoch:
            return current.snapshot_id
        touched = set(self._partial_days(current.through_epoch, through_epoch))
        rows = None
        if touched:
            fresh = self._read("partials", "epoch_id").where(
                (F.col("epoch_id") > current.through_epoch) & (F.col("epoch_id") <= through_epoch)
            )
            base = self._snapshot_rows(current, touched)
            rows = base.select(*PARTIALS.names).unionByName(fresh.select(*PARTIALS.names))
        counted = self._ledger_rows(current.through_epoch, through_epoch).agg(
            *[F.coalesce(F.sum(c), F.lit(0)) for c in LEDGER.names]
        )
        ledger = tuple(a + b for a, b in zip(current.ledger, counted.first(), strict=True))
        self._publish(rows, current.snapshot_id + 1, through_epoch, current.days, ledger)
        return current.snapshot_id + 1

    def last_epoch(self) -> int:
        """The latest epoch with partials or a ledger; -1 before the first."""
        known = self._partial_days(-1).values()
        counted = self._ledger_rows(-1).agg(F.max("epoch_id")).first()[0]
        return max([-1 if counted is None else counted, *known])

    def restore(self, documents: DataFrame, options: RollupOptions = RollupOptions()) -> int:
        """Add snapshot documents (``body``, perhaps ``snapshot_id``) to the history.

        Raises, and leaves the history as it is, if a document is unsound or a
        sum would exceed the 64-bit range. Returns the new snapshot's id.

        Labels take the slots that are free, in the order of their names; those
        beyond ``options.max_segments`` are added to the shared row and counted
        in the ledger, an occurrence each. A label that has a row already, live or
        restored, keeps it. Live labels come after restored ones, as the stream
        counts the published labels among its slots. Documents are checked once:
        their rows are stored, and all steps read these. Meant for the time
        between two epochs: a stream that takes slots at the same moment does not
        see the new ones.
        """
        current = self._current()
        snapshot_id = current.snapshot_id + 1
        staged = f"{self.path}/restores/snapshot_id={snapshot_id}"
        judged = snapshot.judged_rows(snapshot.check_documents(documents))
        judged.write.mode("overwrite").parquet(staged)
        judged = self.spark.read.schema(judged.schema).parquet(staged)
        snapshot.require_sound(judged)
        loaded, folds = self._in_slots(judged.select(*PARTIALS.names), current, options)
        # Partials beyond the snapshot stay and are added on read, so the sums
        # are tried over all there is; writing fails before anything counts.
        days = {r["day"] for r in _with_day(loaded).select("day").distinct().collect()}
        base = self._snapshot_rows(current, days).select(*PARTIALS.names)
        later = self._later(current).select(*PARTIALS.names)
        if not later.isEmpty():
            every = base.unionByName(later).unionByName(loaded)
            rollups.merge_multi(every).write.format("noop").mode("overwrite").save()
        ledger = list(current.ledger)
        ledger[LEDGER.names.index("segment_overflows")] += folds
        self._publish(base.unionByName(loaded), snapshot_id, current.through_epoch, current.days, tuple(ledger))
        return snapshot_id

    def _in_slots(
        self, rows: DataFrame, current: Publication, options: RollupOptions
    ) -> tuple[DataFrame, int]:
        """``rows`` with labels that get no slot folded, and how many were."""
        held = _names(
            self._snapshot_rows(current, {_NO_DAY}).unionByName(self._later(current, {_NO_DAY}))
        )
        used = {r["dimension"]: r["count"] for r in held.groupBy("dimension").count().collect()}
        known = held
        for dimension in rollups.DIMENSIONS:
            free = max(options.max_segments - used.get(dimension, 0), 0)
            own = F.col("dimension") == dimension
            new = _names(rows).where(own).join(held.where(own), ["dimension", "name"], "left_anti")
            known = known.unionByName(new.orderBy("name").limit(free))
        known = known.select(F.col("dimension").alias("grain"), "name", F.lit(True).alias("_known"))
        labelled = rows.where(F.col("grain") != "minute").join(known, ["grain", "name"], "left")
        folds = F.col("_known").isNull() & (F.col("name") != OVERFLOW_LABEL)
        labelled = labelled.withColumn("_folded", folds)
        counted = labelled.agg(F.count_if("_folded")).first()[0]
        folded = labelled.withColumn("name", F.when(F.col("_folded"), OVERFLOW_LABEL).otherwise(F.col("name")))
        minutes = rows.where(F.col("grain") == "minute")
        return minutes.unionByName(folded.select(*PARTIALS.names)), counted

    def vacuum(self) -> int:
        """Delete what the last but one publication already replaced, so that
        listings stay short; readers of the former snapshot are not disturbed.
        Returns the number of folders deleted."""
        known = self._publications(2)
        if len(known) < 2:
            return 0
        through, oldest = known[1].through_epoch, known[1].snapshot_id
        held = {(snapshot_id, day) for p in known for day, (snapshot_id, _) in p.days.items()}
        jvm = self.spark._jvm
        folder = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = folder("").getFileSystem(self.spark._jsc.hadoopConfiguration())

        def numbered(kind: str, key: str):
            for status in fs.listStatus(folder(kind)) if fs.exists(folder(kind)) else ():
                name = status.getPath().getName()
                number = name.removeprefix(key)
                if name.startswith(key) and number.isdigit():
                    yield int(number), status.getPath()

        deleted = 0
        for kind, key, gone in (
            ("partials", "epoch_id=", lambda n: n <= through),
            ("ledger", "epoch_id=", lambda n: n <= through),
            ("restores", "snapshot_id=", lambda n: n <= known[0].snapshot_id),
            ("session_gauge", "epoch_id=", lambda n: n < through),
        ):
            for number, path in numbered(kind, key):
                deleted += gone(number) and bool(fs.delete(path, True))
        for number, path in numbered("snapshots", "snapshot_id="):
            if number >= oldest:
                continue
            days = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("day=")]
            spare = [d for d in days if (number, d.getName().removeprefix("day=")) not in held]
            # A folder none of whose days is read any more goes whole.
            for target in [path] if len(spare) == len(days) else spare:
                deleted += bool(fs.delete(target, True))
        return deleted


def _names(rows: DataFrame) -> DataFrame:
    """Distinct (dimension, name) of label rows, without the reserved name."""
    labels = rows.where((F.col("grain") != "minute") & (F.col("name") != OVERFLOW_LABEL))
    return labels.select(F.col("grain").alias("dimension"), "name").distinct()


def _day_name(number: int) -> str:
    """ISO date of a day counted from 1970-01-01."""
    return (date(1970, 1, 1) + timedelta(days=number)).isoformat()


def _with_day(rows: DataFrame) -> DataFrame:
    day = F.when(F.col("grain") == "minute", day_of(F.col("minute_ms")).cast("string"))
    return rows.select(*PARTIALS.names).withColumn("day", F.coalesce(day, F.lit(_NO_DAY)))


def _by_day(rows: DataFrame) -> DataFrame:
    # Minutes of a day come together in one file (at most 1440 rows); labels,
    # which have no day, are spread by name however many there are.
    return _with_day(rows).repartition("day", "name").sortWithinPartitions("day", "minute_ms", "name")
