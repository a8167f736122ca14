"""Dates and period indexes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column | str) -> Column:
    """Text of the shapes yyyy-MM-dd, yyyy-MM and yyyy as a date (missing parts: the first); others null."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    full = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), c).when(c.rlike(r"^\d{4}-\d{1,2}$"), F.concat(c, F.lit("-01"))).when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01")))
    return F.try_to_date(F.regexp_extract(full, r"^(\d{4}-\d{1,2}-\d{1,2})", 1), "yyyy-M-d")


def has_date_shape(text: Column | str) -> Column:
    """At least a year and a month."""
    return (F.col(text) if isinstance(text, str) else text).rlike(r"^\d+-\d+.*")


def week_index(d: Column | str, start: Column | str, period: int = 7) -> Column:
    """Whole periods since ``start``; the first period is 0."""
    return F.floor(F.datediff(d, start) / F.lit(period)).cast("int")


def week_after(d: Column | str, cutoff: Column | str, period: int = 7) -> Column:
    """Periods after ``cutoff``, from 1; day 0 is 0."""
    return F.ceil(F.datediff(d, cutoff) / F.lit(period)).cast("int")
