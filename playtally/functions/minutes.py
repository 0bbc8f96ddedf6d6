"""Epoch milliseconds, UTC minutes and their labels.

Everything here is integer and date arithmetic, so no result depends on the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playtally.options import DAY_MS, MINUTE_MS

# First and last representable millisecond (years 1970..9999).
MIN_TIMESTAMP_MS = 0
MAX_TIMESTAMP_MS = 253_402_300_799_999

LONG_MIN = -(2**63)
LONG_MAX = 2**63 - 1


def minute_of(ms: Column) -> Column:
    """Start of the UTC minute holding ``ms``; floors toward the past.

    NULL where that start is below the 64-bit range.
    """
    return F.try_subtract(ms, F.pmod(ms, F.lit(MINUTE_MS).cast("bigint")))


def minute_floor(ms: int) -> int:
    """:func:`minute_of` for an argument that is already on the driver."""
    return ms - ms % MINUTE_MS


def day_of(ms: Column) -> Column:
    """UTC date holding ``ms``; NULL outside of the years that have a label."""
    day = F.floor(ms / F.lit(float(DAY_MS))).try_cast("int")
    return F.when(in_time_domain(ms), F.date_from_unix_date(day))


def day_start(ms: Column) -> Column:
    """First millisecond of the UTC day holding ``ms``."""
    return ms - F.pmod(ms, F.lit(DAY_MS).cast("bigint"))


def _within_day(ms: Column, unit_ms: int, modulo: int) -> Column:
    in_day = F.pmod(ms, F.lit(DAY_MS).cast("bigint"))
    return F.pmod(F.floor(in_day / F.lit(unit_ms)), F.lit(modulo)).cast("int")


def hour_in_day(ms: Column) -> Column:
    return _within_day(ms, 3_600_000, 24)


def minute_in_hour(ms: Column) -> Column:
    return _within_day(ms, MINUTE_MS, 60)


def calendar(ms: Column) -> list[Column]:
    """Year, month, day, hour and minute columns (``y mo d h mi``)."""
    day = day_of(ms)
    return [
        F.year(day).alias("y"),
        F.month(day).alias("mo"),
        F.dayofmonth(day).alias("d"),
        hour_in_day(ms).alias("h"),
        minute_in_hour(ms).alias("mi"),
    ]


def iso_minute(ms: Column) -> Column:
    """``YYYY-MM-DDTHH:MM`` label of the minute holding ``ms``."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(
        day_of(ms).cast("string"),
        F.lit("T"),
        two(hour_in_day(ms)),
        F.lit(":"),
        two(minute_in_hour(ms)),
    )


def time_of_day(label: Column) -> Column:
    """``HH:MM`` part of a minute label."""
    return F.substring(label, 12, 5)


def label_to_ms(label: Column) -> Column:
    """Inverse of :func:`iso_minute`; NULL when the label is malformed."""
    shape = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d$"
    days = F.unix_date(F.substring(label, 1, 10).try_cast("date")).cast("bigint")
    hours = F.substring(label, 12, 2).try_cast("bigint")
    minutes = F.substring(label, 15, 2).try_cast("bigint")
    return F.when(
        label.rlike(shape),
        days * F.lit(DAY_MS) + hours * F.lit(3_600_000) + minutes * F.lit(MINUTE_MS),
    )


def in_time_domain(ms: Column) -> Column:
    return ms.between(F.lit(MIN_TIMESTAMP_MS), F.lit(MAX_TIMESTAMP_MS))


def saturating_shift(ms: Column, delta: int) -> Column:
    """``ms + delta`` clamped to the 64-bit range instead of overflowing."""
    if delta >= 0:
        return F.when(ms > F.lit(LONG_MAX - delta), F.lit(LONG_MAX)).otherwise(ms + F.lit(delta))
    return F.when(ms < F.lit(LONG_MIN - delta), F.lit(LONG_MIN)).otherwise(ms + F.lit(delta))
