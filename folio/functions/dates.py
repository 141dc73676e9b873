"""Dates as cards, archives and feeds show them. Timestamps are instants; the session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_zone(instant: Column, tz: str = "UTC") -> Column:
    """The wall-clock time in a zone."""
    return F.from_utc_timestamp(instant.cast("timestamp"), tz)


def iso_date(instant: Column) -> Column:
    """yyyy-MM-dd in UTC."""
    return F.date_format(instant.cast("timestamp"), "yyyy-MM-dd")


def month_day(instant: Column, tz: str = "UTC") -> Column:
    """MM-dd in a reader's zone."""
    return F.date_format(in_zone(instant, tz), "MM-dd")


def year(instant: Column, tz: str = "UTC") -> Column:
    return F.year(in_zone(instant, tz)).cast("long")


def today(tz: str = "UTC") -> Column:
    return F.date_format(in_zone(F.current_timestamp(), tz), "yyyy-MM-dd")


def current_year(tz: str = "UTC") -> Column:
    return year(F.current_timestamp(), tz)


def coerced(text: Column) -> Column:
    """A timestamp from front matter; null if it is none."""
    return F.try_to_timestamp(text)


def track_time(seconds: Column) -> Column:
    """m:ss; 0:00 for what is not finite."""
    s = F.floor(seconds.cast("double")).cast("long")
    finite = seconds.isNotNull() & ~F.isnan(seconds.cast("double")) & (F.abs(seconds.cast("double")) != float("inf"))
    return F.when(finite, F.format_string("%d:%02d", F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60)))).otherwise("0:00")


def rfc822(instant: Column) -> Column:
    """As feeds write dates."""
    return F.date_format(instant.cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
