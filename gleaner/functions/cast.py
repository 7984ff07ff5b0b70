"""Tolerant casts: what can't be read becomes null instead of an error (ANSI mode is on)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_float(c: Column) -> Column:
    """Null, empty and unreadable values give null."""
    return F.trim(c.cast("string")).try_cast("double")


def to_int(c: Column) -> Column:
    """Through a float, truncated towards zero; null, NaN and out-of-range values give null."""
    return F.when(~F.isnan(to_float(c)), to_float(c)).try_cast("int")


def to_datetime(c: Column) -> Column:
    """ISO date-time (with or without zone), else its first 19 characters, else its first 10 as a date."""
    return F.coalesce(c.try_cast("timestamp"), F.substring(c, 1, 19).try_cast("timestamp"), F.substring(c, 1, 10).try_cast("date").cast("timestamp"))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor an empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def expires_in_days(expires: Column, now: Column) -> Column:
    """Whole days until `expires`, not below 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(expires.cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))) / 86400))
