"""Dates of the calendar; the session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def weekday(d: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(d) - 1


def long_date(d: Column) -> Column:
    return F.date_format(d, "EEEE, d MMMM yyyy")


def office_of(ts: Column, hinge_hour: int = 15) -> Column:
    return F.when(F.hour(ts) >= hinge_hour, "ep").otherwise("mp")


def month_first(c: Column) -> Column:
    """``12 January (or …)`` as ``January 12``."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s*(?:\(or [^)]*\)|—.*)", "")), rf"^(\d{{1,2}}) ({MONTHS})$", "$2 $1")


def week_index(d: Column, start: Column) -> Column:
    """Weeks since ``start``, downwards; 0 without a start."""
    return F.coalesce(F.floor(F.datediff(d, start) / 7), F.lit(0))

