"""Instants and days as integers, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND


def instant_micros(text: Column) -> Column:
    """Epoch microseconds of an ISO instant in any written offset; a text without offset is UTC, an unreadable one null."""
    text = F.trim(text)
    zoned = text.endswith("Z") | text.rlike(r"[T ][0-9:.]+[+-]\d{2}(:?\d{2})?$")
    return F.unix_micros(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp"))


def day_number(text: Column) -> Column:
    """Days since 1970-01-01 of a YYYY-MM-DD text, null unless it is a real day."""
    return F.unix_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).try_cast("date"))


def utc_day(instant: Column) -> Column:
    """Days since 1970-01-01 in UTC of a timestamp, whatever the session's time zone."""
    return F.floor(F.unix_micros(instant) / F.lit(MICROS_PER_DAY)).cast("int")


def is_missing(value: Column) -> Column:
    """Null and NaN both mean missing."""
    return value.isNull() | F.isnan(value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def day_start_micros(day: Column) -> Column:
    """First microsecond (UTC) of a date."""
    return F.unix_date(day).cast("long") * F.lit(MICROS_PER_DAY)
