"""Dates, times and months.

Times of day are ``HH:mm:ss`` text: fixed width, so comparing text compares times. Months are ``yyyyMM``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesledger.functions.text import group_or_null

# --- fixed values ------------------------------------------------------------------------------------
DAY_START = "06:00:00"
DAY_END = "18:00:00"
SHIFT_EARLIEST = "12:00:00"
SHIFT_LATEST = "16:00:00"
DEFAULT_SHIFT_CHANGE = "14:15:00"
FIRST_YEAR, LAST_YEAR = 2023, 2100
SALE_DATE = r".?(\d\d\.\d\d\.\d\d\d\d), "
BOOKING_DATE = r"(\d\d\d\d-\d\d-\d\d)"
BEFORE_BOOKING_TIME = r".{11}"
TIME_OF_DAY = r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d"


def _sale_day(sold_at: Column) -> Column:
    # One pattern per row: the parts stand at fixed places of what it finds, and without a match they are empty.
    day = F.regexp_extract(sold_at, SALE_DATE, 1)
    return F.nullif(F.concat(F.substring(day, 7, 4), F.lit("-"), F.substring(day, 4, 2), F.lit("-"), F.substring(day, 1, 2)), F.lit("--"))


def sale_date(sold_at: Column) -> Column:
    """Date of ``dd.MM.yyyy, HH:mm``; null without a match, an error for a day that does not exist."""
    return _sale_day(sold_at).cast("date")


def impossible_sale_date(sold_at: Column) -> Column:
    """Whether the text has the form of a date but the day does not exist, such as 31.02.2024."""
    # A day that exists decides at once, so the pattern is tried once for it.
    return _sale_day(sold_at).try_cast("date").isNull() & _sale_day(sold_at).isNotNull()


def booking_date(booked_at: Column) -> Column:
    return group_or_null(booked_at, BOOKING_DATE).cast("date")


def impossible_booking_date(booked_at: Column) -> Column:
    day = group_or_null(booked_at, BOOKING_DATE)
    return day.try_cast("date").isNull() & day.isNotNull()


def booking_time(booked_at: Column) -> Column:
    """Time of ``yyyy-MM-dd HH:mm:ss``; null when there is none. ``unreadable_times`` finds impossible ones."""
    return group_or_null(booked_at, f"{BEFORE_BOOKING_TIME}({TIME_OF_DAY})")


def is_weekend(date: Column) -> Column:
    return F.weekday(date) >= 5


def month_of(date: Column) -> Column:
    return F.replace(F.left(date.cast("string"), F.lit(7)), F.lit("-"), F.lit(""))


def first_of_month(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("01")), "yyyyMMdd")


def last_of_month(month: Column) -> Column:
    return F.last_day(first_of_month(month))


def cut_off(month: Column) -> Column:
    """First day after the month."""
    return F.add_months(first_of_month(month), 1)


def is_supported_month(month: Column) -> Column:
    """Six digits, a year from 2023 to 2100 and a month from 01 to 12."""
    year = F.substring(month, 1, 4).try_cast("int")
    return F.coalesce(
        month.rlike(r"^\d{4}(0[1-9]|1[0-2])\z") & year.between(FIRST_YEAR, LAST_YEAR), F.lit(False)
    )


def month_of_file(file_name: Column, prefix: str, extension: str) -> Column:
    """The six characters after ``<prefix>_`` in a name that ends in ``.<extension>``; null when it does not have that form."""
    return group_or_null(file_name, rf"(?s)^\Q{prefix}\E_(.{{6}}).*(?i:\Q.{extension}\E)\z")
