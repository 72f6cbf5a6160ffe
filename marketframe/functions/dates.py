"""Dates, times and time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_start_text(date: Column) -> Column:
    """A date, or its text as YYYY-MM-DD, as ``YYYY-MM-DDT00:00:00Z``; a malformed text is an error."""
    return F.date_format(F.to_date(date, "yyyy-MM-dd"), "yyyy-MM-dd'T'00:00:00'Z'")


def parsed_time(col: Column, kind: str, pattern: str = "yyyy-MM-dd") -> Column:
    """A timestamp from a text, date or timestamp column, by its Spark type."""
    if kind == "string":
        return F.to_timestamp(col, pattern)
    return col.cast("timestamp")


def in_zone(ts: Column, zone: str, source: str = "UTC") -> Column:
    """Wall-clock time in ``zone`` of a timestamp, as a timestamp without a zone.

    The session's time zone is taken to be ``source``.
    """
    return F.convert_timezone(F.lit(source), F.lit(zone), ts.cast("timestamp_ntz"))


def session_label(ts: Column, zone: str = "America/New_York") -> Column:
    """The label of the daily bar that ``ts`` falls in: its UTC day's start, as wall-clock time in ``zone``, a day later."""
    return in_zone(F.date_trunc("day", ts), zone) + F.expr("INTERVAL 1 DAY")


def from_nanos(ns: Column) -> Column:
    """A timestamp from epoch nanoseconds; what is below a microsecond is dropped."""
    # a multiple of 1000, so that rounding mends what division as doubles loses
    return F.timestamp_micros(F.round((ns - F.pmod(ns, F.lit(1000))) / 1000).cast("bigint"))
