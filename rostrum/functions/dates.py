"""Dates from paths, file names and texts, and the ranges that searches ask for. Bad dates are null, never an error."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONTH_NUMBERS
from . import patterns as P
from .text import col, group


def month_number(name: Column) -> Column:
    """1 to 12 of a full or short English month name, else null."""
    table = F.create_map(*[F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair])
    return F.try_element_at(table, F.coalesce(name, F.lit("")))


def make_date(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%s-%02d-%s", year, month, F.lpad(day, 2, "0")).try_cast("date")


def path_date(path) -> Column:
    """The date of .../YYYY/Month/D/..., wherever the year stands."""
    at = [F.regexp_extract(col(path), r"/(\d{4})/([A-Za-z]+)/(\d{1,2})/", k) for k in (1, 2, 3)]
    return F.when(at[0] != "", make_date(at[0], month_number(at[1]), at[2]))


def path_source(path) -> Column:
    """The part of the path after collections."""
    parts = F.split(col(path), "/")
    at = F.array_position(parts, "collections").cast("int")
    return F.coalesce(F.when(at > 0, F.nullif(F.try_element_at(parts, at + 1), F.lit(""))), F.lit("Unknown Source"))


def filename_date(name) -> Column:
    """By the first pattern that matches: DAY-n-Wed-21-May-25, then Wednesday-3-March-1999."""
    found = []
    for pattern, century in P.FILE_DATES:
        year = group(name, pattern, 3)
        found.append(make_date((year.try_cast("int") + century).cast("string") if century else year, month_number(group(name, pattern, 2)), group(name, pattern, 1)))
    return F.coalesce(*found)


def text_date(text) -> Column:
    """The first date in a text: with its weekday and the day first, else with the month first."""
    long = make_date(group(text, P.TEXT_DATE_LONG, 3), month_number(group(text, P.TEXT_DATE_LONG, 2)), group(text, P.TEXT_DATE_LONG, 1))
    short = make_date(group(text, P.TEXT_DATE, 3), month_number(group(text, P.TEXT_DATE, 1)), group(text, P.TEXT_DATE, 2))
    return F.coalesce(long, short)


def long_date(d) -> Column:
    """Friday, December 6, 2024; Unknown date for null."""
    return F.coalesce(F.date_format(col(d), "EEEE, MMMM d, yyyy"), F.lit("Unknown date"))


def range_start(now: date, period: str) -> Column:
    """Where the last day, week, month or year began. Months roll over: a month before March 31 is March 3 (2 in leap years)."""
    today = F.lit(now)
    if period in ("day", "week"):
        return F.date_sub(today, {"day": 1, "week": 7}[period])
    first = F.add_months(F.trunc(today, "MM"), {"month": -1, "year": -12}[period])
    return F.date_add(first, F.dayofmonth(today) - 1)
