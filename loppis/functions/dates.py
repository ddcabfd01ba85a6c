"""Dates and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hammered_date(c: Column) -> Column:
    """Date of "Hammered 11 Dec 2016", or null."""
    return F.to_date(F.try_to_timestamp(F.regexp_extract(c, r"Hammered\s+(\d{1,2}\s+\w+\s+\d{4})", 1), F.lit("d MMM yyyy")))


def stale_before(now: Column, hours: int = 0, days: int = 0) -> Column:
    return now - F.make_dt_interval(F.lit(days), F.lit(hours))


def age(then: Column, now: Column) -> Column:
    """"Just now", minutes, hours or days ago."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    mins, hours, days = (F.floor(seconds / n).cast("string") for n in (60, 3600, 86400))
    return (
        F.when(seconds < 60, "Just now")
        .when(seconds < 3600, F.concat(mins, F.lit("m ago")))
        .when(seconds < 86400, F.concat(hours, F.lit("h ago")))
        .otherwise(F.concat(days, F.lit("d ago")))
    )


def valid_year(year: Column) -> Column:
    return year.between(1900, 2030)
