"""Semantics that engines disagree on, decided once: boundary differences, buckets, ratios, text comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: "Today" of the relative time shapes; never the wall clock.
AS_OF_ORDERS = "2001-08-01"
AS_OF_EVENTS = "2024-01-31"

_SECONDS = {"hour": 3600, "minute": 60, "second": 1}


def boundary_diff(unit: str, start: Column, end: Column) -> Column:
    """Boundaries of `unit` crossed from start to end (00:59 to 01:01 crosses one hour). Weeks begin on Monday."""
    if unit in _SECONDS:
        seconds = F.unix_seconds(F.date_trunc(unit, end).cast("timestamp")) - F.unix_seconds(F.date_trunc(unit, start).cast("timestamp"))
        return (seconds / _SECONDS[unit]).cast("bigint")
    if unit == "day":
        return F.datediff(end, start).cast("bigint")
    if unit == "week":
        return (F.datediff(F.date_trunc("week", end), F.date_trunc("week", start)) / 7).cast("bigint")
    months = (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))
    if unit == "month":
        return months.cast("bigint")
    if unit == "quarter":
        return ((F.year(end) * 4 + F.quarter(end)) - (F.year(start) * 4 + F.quarter(start))).cast("bigint")
    if unit == "year":
        return (F.year(end) - F.year(start)).cast("bigint")
    raise ValueError(f"unknown unit {unit}")


def bucket(unit: str, col: Column) -> Column:
    """The first day of the day, ISO week, month, quarter or year."""
    return F.date_trunc(unit, col).cast("date")


def half_open(col: Column, first: str, after: str) -> Column:
    return (col >= F.lit(first).cast("timestamp_ntz")) & (col < F.lit(after).cast("timestamp_ntz"))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """100 * part / whole; null for an empty whole."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def rate(part: Column, whole: Column) -> Column:
    """Percent to one digit, half to even; 0 for an empty whole."""
    return F.when(whole == 0, 0.0).otherwise(F.bround(100.0 * part / whole, 1))


def contains_fold(col: Column, what: str) -> Column:
    return F.lower(col).contains(what.lower())
