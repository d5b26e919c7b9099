"""Functions on timestamps; the session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folder_date(modified: Column) -> Column:
    """Midnight of the day of the last modification."""
    return F.date_trunc("DAY", modified)


def unix_ms_to_ts(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def ts_to_unix_ms(ts: Column) -> Column:
    """Milliseconds since the epoch, cut toward zero; 0 for NULL."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.coalesce(F.call_function("div", micros, F.lit(1000)), F.lit(0).cast("bigint"))


def specify_utc(ts: Column) -> Column:
    """A timestamp without a zone is taken as UTC; one with a zone is unchanged."""
    return ts.cast("timestamp")


def parse_bound(text: Column) -> Column:
    """A window bound as UTC; NULL when it cannot be read.

    Accepts full timestamps, dates, and a date directly followed by a zone.
    """
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-ddX")))
