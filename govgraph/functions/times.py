"""UTC time checks on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of UTC days and instants.
UTC_DAY = r"^\d{4}-\d{2}-\d{2}\z"
UTC_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z\z"
UTC_SECOND = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"


def valid_utc_day(value: Column) -> Column:
    """True for a ``yyyy-MM-dd`` day that exists in the calendar."""
    return F.coalesce(value.rlike(UTC_DAY) & value.try_cast("date").isNotNull(), F.lit(False))


def valid_utc_instant(value: Column) -> Column:
    """True for an instant with explicit ``Z`` that exists in the calendar."""
    real = F.substring(value, 1, 19).try_cast("timestamp").isNotNull()
    return F.coalesce(value.rlike(UTC_INSTANT) & real, F.lit(False))


def valid_utc_second(value: Column) -> Column:
    """True for the second-precision spelling; the calendar is not consulted."""
    return F.coalesce(value.rlike(UTC_SECOND), F.lit(False))


def utc_second(value: Column) -> Column:
    """A timestamp rendered in second precision with ``Z``."""
    return F.date_format(F.date_trunc("second", value), "yyyy-MM-dd'T'HH:mm:ss'Z'")
