"""Time helpers that stay JVM-side and do not depend on the session time zone.

Event times are ``timestamp_ntz`` (wall clock); arithmetic goes through whole
microseconds since the epoch built from date parts, so buckets, gaps and elapsed
days are exact integers under any session zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND


def epoch_micros(col: Column | str) -> Column:
    """Wall-clock microseconds since 1970-01-01 of a ``timestamp_ntz`` — built from date
    parts, so no session time zone (and no DST shift) ever enters the arithmetic."""
    c = F.col(col) if isinstance(col, str) else col
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    secs = F.date_part(F.lit("SECOND"), c)  # decimal(8,6): exact seconds with fraction
    return (days * F.lit(MICROS_PER_DAY) + F.hour(c).cast("bigint") * F.lit(3_600 * MICROS_PER_SECOND)
            + F.minute(c).cast("bigint") * F.lit(60 * MICROS_PER_SECOND)
            + (secs * F.lit(MICROS_PER_SECOND)).cast("bigint"))


def time_bucket(col: Column | str, width_seconds: int) -> Column:
    """Integer bucket of fixed width (floor division, exact), monotone in time."""
    m = epoch_micros(col)
    w = F.lit(width_seconds * MICROS_PER_SECOND)
    return ((m - F.pmod(m, w)) / w).cast("bigint")


def day_start(col: Column | str) -> Column:
    """Midnight of the day, kept as ``timestamp_ntz`` (date_trunc alone returns LTZ)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.to_timestamp_ntz(F.to_date(c))


def minus_days(col: Column | str, days: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c - F.make_dt_interval(F.lit(days))


def whole_days_between(start: Column, end: Column) -> Column:
    """Whole elapsed days (a ``timedelta.days``: floor, also when negative), not midnights
    crossed; zone-free like ``epoch_micros``."""
    d = epoch_micros(end) - epoch_micros(start)
    day = F.lit(MICROS_PER_DAY)
    return ((d - F.pmod(d, day)) / day).cast("bigint")
