"""Reads over minute buckets (``minute_ms`` + counters, one row per minute)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playtally.functions.counters import as_metrics, merge_aggs, zero_counters
from playtally.functions.minutes import (
    LONG_MAX,
    LONG_MIN,
    MAX_TIMESTAMP_MS,
    MIN_TIMESTAMP_MS,
    iso_minute,
    minute_floor,
    time_of_day,
)
from playtally.options import MINUTE_MS, QueryLimits
from playtally.schema import COUNTERS, PLOTTABLE

# The selectable dashboard windows, in buckets.
PRESET_WINDOWS = {"15m": 15, "1h": 60, "6h": 360, "24h": 1440}


def within_minutes(rows: DataFrame, from_ms: int, to_ms: int, column: str) -> DataFrame:
    """Rows of the minutes from ``from_ms`` to ``to_ms``, both included.

    A plain comparison of a stored column with literals, so it reaches the
    scan of an event table (``timestamp_ms``) or bucket table (``minute_ms``).
    """
    last = minute_floor(to_ms) + MINUTE_MS - 1
    return rows.where(
        (F.col(column) >= F.lit(minute_floor(from_ms))) & (F.col(column) <= F.lit(last))
    )


def point(minutes: DataFrame, ms: int) -> DataFrame:
    """The bucket of one minute; no row when the minute has no bucket."""
    return minutes.where(F.col("minute_ms") == F.lit(minute_floor(ms)))


def ordered(minutes: DataFrame) -> DataFrame:
    return minutes.orderBy("minute_ms")


def recent(minutes: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` existing buckets, oldest first (a top-N, no full sort)."""
    return minutes.orderBy(F.col("minute_ms").desc()).limit(max(n, 0)).orderBy("minute_ms")


def span(minutes: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Buckets of an inclusive range whose bounds are cut to their minute."""
    return within_minutes(minutes, from_ms, to_ms, "minute_ms").orderBy("minute_ms")


def with_label(minutes: DataFrame) -> DataFrame:
    return minutes.withColumn("minute", iso_minute(F.col("minute_ms")))


def minute_metrics(minutes: DataFrame) -> DataFrame:
    """Labelled published metrics per minute (no per-view ratio)."""
    return as_metrics(with_label(minutes), ("minute_ms", "minute"), with_ratio=False)


def range_metrics(minutes: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Metrics of a range, each row echoing the bounds as minute labels."""
    echo = lambda ms: iso_minute(F.lit(ms).cast("bigint"))
    rows = minute_metrics(span(minutes, from_ms, to_ms))
    return rows.withColumn("from_minute", echo(from_ms)).withColumn("to_minute", echo(to_ms))


def parse_int64(text: object) -> int | None:
    """A 64-bit integer from request text; None for anything else."""
    if isinstance(text, bool) or text is None:
        return None
    if isinstance(text, int):
        value = text
    elif isinstance(text, str) and re.fullmatch(r"-?[0-9]+", text):
        value = int(text)
    else:
        return None
    return value if LONG_MIN <= value <= LONG_MAX else None


def live_minutes(requested: object = None, limits: QueryLimits = QueryLimits()) -> int:
    """Number of buckets a live read gives: a hint, clamped and never refused."""
    n = parse_int64(requested)
    if n is None or n <= 0:
        n = limits.default_minutes
    return min(n, limits.max_minutes)


def range_bounds(
    from_ms: object, to_ms: object, limits: QueryLimits = QueryLimits()
) -> tuple[int, int]:
    """Checked bounds of a range read. A range is refused, never shortened."""
    low, high = parse_int64(from_ms), parse_int64(to_ms)
    if low is None or high is None:
        raise ValueError("both bounds of the range are required, in epoch milliseconds")
    for bound in (low, high):
        if not MIN_TIMESTAMP_MS <= bound <= MAX_TIMESTAMP_MS:
            raise ValueError(
                f"bounds must lie within {MIN_TIMESTAMP_MS}..{MAX_TIMESTAMP_MS} ms"
            )
    if low > high:
        raise ValueError("the lower bound lies after the upper bound")
    minutes = (high - low) // MINUTE_MS + 1
    if minutes > limits.max_minutes:
        raise ValueError(
            f"range covers {minutes} minutes, limit is {limits.max_minutes}: ask for a narrower one"
        )
    return low, high


_HOUR, _DAY = 60, 1440


def _running(rows: DataFrame, unit: str, per: int) -> DataFrame:
    """For every step ``at`` from the first row of a block of ``per`` steps to the block's end, what the block has up to it."""
    order = W.partitionBy(F.expr(f"at div {per}")).orderBy("at")
    sums = [F.sum(c).over(order).alias(c) for c in (*COUNTERS, "buckets")]
    until = F.lead("at").over(order)
    # Of rows of one step the last has the step after it next, and the sums of all.
    found = rows.select("at", until.alias("until"), *sums).where("until IS NULL OR until > at")
    steps = F.expr(f"explode(sequence(at, coalesce(until, (at div {per} + 1) * {per}) - 1)) AS step")
    return found.select(F.lit(unit).alias("unit"), steps, *COUNTERS, "buckets").withColumnRenamed("step", "at")


def _pieces() -> str:
    """What makes up minutes ``a`` to ``b``: whole days from that of ``a``, the day of ``b`` up to it, less that of ``a`` before it.

    A day up to a minute is its hours up to the one before, and the minute's hour up to it.
    """
    piece = lambda unit, at, sign: f"named_struct('unit', '{unit}', 'at', {at}, 'sign', {sign}L)"
    some = lambda test, unit, at, sign: f"IF({test}, array({piece(unit, at, sign)}), array())"
    day_a, day_b, hour_a, hour_b = f"a div {_DAY}", f"b div {_DAY}", f"a div {_HOUR}", f"b div {_HOUR}"
    # Within one hour the hours before it cancel out.
    apart = f"{hour_a} <> {hour_b}"
    days = (
        f"IF({day_a} < {day_b}, transform(sequence({day_a}, {day_b} - 1), x -> {piece('day', 'x', 1)}), array())"
    )
    return (
        f"concat(array({piece('minute', 'b', 1)}), {some(f'a % {_HOUR} <> 0', 'minute', 'a - 1', -1)},"
        f" {some(f'{apart} AND b % {_DAY} >= {_HOUR}', 'hour', f'{hour_b} - 1', 1)},"
        f" {some(f'{apart} AND a % {_DAY} >= {_HOUR}', 'hour', f'{hour_a} - 1', -1)}, {days})"
    )


def range_requests(
    minutes: DataFrame, requests: DataFrame, limits: QueryLimits = QueryLimits()
) -> DataFrame:
    """Totals of many ranges at once, by the rules of :func:`range_bounds`.

    ``requests`` has ``request_id`` and the texts ``from_ms`` and ``to_ms``. Every
    distinct request gives one row: ``outcome`` (``ok``, ``missing_bound``,
    ``out_of_domain``, ``reversed`` or ``too_wide``), for ``ok`` the echoed bounds, the
    number of buckets in the range and their metrics; the others have none and
    zeroes. A request without an id is one like any other.

    A range is the difference of running sums of a day, looked up at its two ends by
    equal keys, and the whole days between: no range join, at most four pieces and one a
    day, and a request costs the same however many events a minute holds. Sums of a
    day must fit 64 bits. Only the request itself goes with its pieces.
    """
    number = lambda c: f"IF({c} RLIKE r'\\A-?[0-9]+\\z', try_cast({c} AS BIGINT), NULL)"
    inside = lambda c: f"{c} BETWEEN {MIN_TIMESTAMP_MS} AND {MAX_TIMESTAMP_MS}"
    minute = lambda c: f"{c} div {MINUTE_MS}"
    outcome = (
        "CASE WHEN lo IS NULL OR hi IS NULL THEN 'missing_bound'"
        f" WHEN NOT ({inside('lo')} AND {inside('hi')}) THEN 'out_of_domain'"
        " WHEN lo > hi THEN 'reversed'"
        f" WHEN (hi - lo) div {MINUTE_MS} + 1 > {limits.max_minutes} THEN 'too_wide' ELSE 'ok' END"
    )
    keys = ["request_id", "from_ms", "to_ms"]
    judged = ["*", f"{number('from_ms')} AS lo", f"{number('to_ms')} AS hi"]
    # A refused request has one piece that meets nothing, by a key of its own: no task gets all of them.
    nothing = f"array(named_struct('unit', 'none', 'at', xxhash64({', '.join(keys)}), 'sign', 0L))"
    asked = (
        requests.selectExpr("request_id", "CAST(from_ms AS STRING) AS from_ms", "CAST(to_ms AS STRING) AS to_ms")
        .distinct()
        .selectExpr(*judged)
        .selectExpr("*", f"{outcome} AS outcome")
        .selectExpr("*", f"IF(outcome = 'ok', {minute('lo')}, NULL) AS a", f"IF(outcome = 'ok', {minute('hi')}, NULL) AS b")
        .selectExpr(*keys, f"explode(IF(outcome = 'ok', {_pieces()}, {nothing})) AS p")
        .selectExpr(*keys, "p.unit AS unit", "p.at AS at", "p.sign AS sign")
    )
    # No range asks for more.
    inside_domain = minutes.where(F.col("minute_ms").between(MIN_TIMESTAMP_MS, MAX_TIMESTAMP_MS))
    by_minute = inside_domain.select(F.expr(f"minute_ms div {MINUTE_MS}").alias("at"), *COUNTERS, F.lit(1).alias("buckets"))
    totals = lambda rows, per: rows.groupBy(F.expr(f"at div {per}").alias("at")).agg(
        *merge_aggs(), F.sum("buckets").alias("buckets")
    )
    by_hour = totals(by_minute, _HOUR)
    by_day = totals(by_hour, _DAY // _HOUR).select(F.lit("day").alias("unit"), "at", *COUNTERS, "buckets")
    rollup = _running(by_minute, "minute", _HOUR).unionByName(_running(by_hour, "hour", _DAY // _HOUR)).unionByName(by_day)
    signed = [(F.col("sign") * F.col(c)).alias(c) for c in (*COUNTERS, "buckets")]
    found = asked.join(rollup, ["unit", "at"], "left").select(*keys, *signed).groupBy(*keys)
    found = found.agg(*merge_aggs(), F.coalesce(F.sum("buckets"), F.lit(0)).cast("bigint").alias("buckets"))
    found = found.selectExpr(*judged).selectExpr("*", f"{outcome} AS outcome")
    ok = F.col("outcome") == "ok"
    echo = [F.when(ok, iso_minute(F.col(c))).alias(n) for c, n in (("lo", "from_minute"), ("hi", "to_minute"))]
    return as_metrics(found.withColumns({"from_minute": echo[0], "to_minute": echo[1]}), (
        "request_id", "outcome", "from_minute", "to_minute", "buckets"
    ))


def fill_gaps(minutes: DataFrame, limit: int | None = None) -> DataFrame:
    """Add an all-zero bucket for every minute without one.

    Only between the first and the last bucket. A chart gives the number of
    points it can draw as ``limit``: if there were more, the input comes back
    as it is. The minutes
    to add come from a one-row aggregate, and zeroes add nothing, so filling
    is a union and a merge: no join.
    """
    bounds = minutes.agg(
        F.min("minute_ms").alias("lo"),
        F.max("minute_ms").alias("hi"),
        F.count(F.lit(1)).alias("n"),
    )
    width = F.expr(f"(hi - lo) div {MINUTE_MS} + 1")
    spine = (
        bounds.where((F.col("n") >= 2) & (width > F.col("n")) & (F.lit(True) if limit is None else width <= limit))
        .select(F.explode(F.sequence("lo", "hi", F.lit(MINUTE_MS).cast("bigint"))).alias("minute_ms"))
        .select("minute_ms", *zero_counters())
    )
    return (
        minutes.select("minute_ms", *COUNTERS)
        .unionByName(spine)
        .groupBy("minute_ms")
        .agg(*merge_aggs())
    )


def window_totals(minutes: DataFrame) -> DataFrame:
    """One row of metrics over the given buckets.

    Means are taken from summed samples, which weights every bucket by its
    sample count and gives the same digits whatever the row order.
    """
    return as_metrics(minutes.agg(*merge_aggs()))


def kpi_panels(
    minutes: DataFrame,
    windows: dict[str, int],
    limit: int = QueryLimits().gap_fill_minutes,
) -> DataFrame:
    """Totals over the latest buckets, for several windows in one pass.

    ``points`` is the number of points a gap-filled chart of the window shows.
    The buckets that filling adds are all zero, so they are only counted. The
    widest window is taken by a top-N; its buckets are few and are ranked and
    assigned to the windows they belong to.
    """
    latest = minutes.orderBy(F.col("minute_ms").desc()).limit(max(windows.values()))
    rank = F.row_number().over(W.orderBy(F.col("minute_ms").desc()))
    member = F.array_compact(
        F.array(*[F.when(F.col("rank") <= n, F.lit(name)) for name, n in windows.items()])
    )
    width = F.expr(f"(hi - lo) div {MINUTE_MS} + 1")
    fills = (F.col("n") >= 2) & (width > F.col("n")) & (width <= limit)
    panels = (
        latest.withColumn("rank", rank)
        .withColumn("window_name", F.explode(member))
        .groupBy("window_name")
        .agg(
            *merge_aggs(),
            F.count(F.lit(1)).alias("n"),
            F.min("minute_ms").alias("lo"),
            F.max("minute_ms").alias("hi"),
        )
        .withColumn("points", F.when(fills, width).otherwise(F.col("n")))
    )
    return as_metrics(panels, ("window_name", "points"))


def kpi_panel(minutes: DataFrame, n: int, limit: int = QueryLimits().gap_fill_minutes) -> DataFrame:
    """:func:`kpi_panels` for one window of ``n`` buckets; always one row."""
    latest = minutes.orderBy(F.col("minute_ms").desc()).limit(n)
    width = F.expr(f"(hi - lo) div {MINUTE_MS} + 1")
    fills = (F.col("n") >= 2) & (width > F.col("n")) & (
        width <= limit
    )
    panel = latest.agg(
        *merge_aggs(),
        F.count(F.lit(1)).alias("n"),
        F.min("minute_ms").alias("lo"),
        F.max("minute_ms").alias("hi"),
    ).withColumn("points", F.when(fills, width).otherwise(F.col("n")))
    return as_metrics(panel, ("points",))


def rank_segments(segments: DataFrame, metric: str) -> DataFrame:
    """Segments by a metric, largest first, equal ones by name."""
    _check_metric(metric)
    return (
        as_metrics(segments, ("name",))
        .select("name", F.col(metric).alias("value"))
        .orderBy(F.col("value").desc(), "name")
    )


def chart_series(minutes: DataFrame, metric: str) -> DataFrame:
    """One metric per minute for a chart, labelled by time of day."""
    _check_metric(metric)
    rows = minute_metrics(minutes)
    return rows.select(
        "minute_ms", time_of_day(F.col("minute")).alias("label"), F.col(metric).alias("value")
    ).orderBy("minute_ms")


def chart_all(minutes: DataFrame) -> DataFrame:
    """Every plottable metric of every minute in long form."""
    rows = minute_metrics(minutes).select(
        "minute_ms",
        time_of_day(F.col("minute")).alias("label"),
        *[F.col(m).cast("double").alias(m) for m in PLOTTABLE],
    )
    return rows.unpivot(["minute_ms", "label"], list(PLOTTABLE), "metric", "value")


def _check_metric(metric: str) -> None:
    if metric not in PLOTTABLE:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(PLOTTABLE)}")
