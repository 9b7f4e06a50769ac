"""Date parsing on the driver (two scalars) and date parts on columns."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The range used when a bound is missing or cannot be parsed.
DEFAULT_START = date(2020, 1, 1)
DEFAULT_END = date(2025, 12, 31)

# ISO weekday numbers.
DAY_NAMES = {
    1: "Monday",
    2: "Tuesday",
    3: "Wednesday",
    4: "Thursday",
    5: "Friday",
    6: "Saturday",
    7: "Sunday",
}

DateLike = date | datetime | str | None

# Days and weeks in ISO form, with both hyphens or with none.
_ISO_DAY = re.compile(r"(\d{4})(-?)(\d{2})\2(\d{2})", re.ASCII)
_ISO_WEEK = re.compile(r"(\d{4})(-?)W(\d{2})(?:\2([1-7]))?", re.ASCII)


def to_date(value: DateLike, fallback: date) -> date:
    """The day that the first ten characters spell in ISO form; fallback if they spell none.

    That form is a day or a weekday, written with hyphens or without; a week
    alone is its Monday. Dates and timestamps write themselves that way, so they
    need no rule of their own.
    """
    spelled = str(value)[:10]
    if day := _ISO_DAY.fullmatch(spelled):
        year, month, number = (int(day[part]) for part in (1, 3, 4))
        real = 1 <= month <= 12 and year > 0 and 1 <= number <= monthrange(year, month)[1]
        return date(year, month, number) if real else fallback
    if week := _ISO_WEEK.fullmatch(spelled):
        year, number = int(week[1]), int(week[3])
        real = 0 < year < 9999 and 1 <= number <= date(year, 12, 28).isocalendar().week
        return date.fromisocalendar(year, number, int(week[4] or 1)) if real else fallback
    return fallback


def ordered_range(start: DateLike, end: DateLike) -> tuple[date, date]:
    """Both bounds parsed, the earlier one first."""
    low, high = sorted((to_date(start, DEFAULT_START), to_date(end, DEFAULT_END)))
    return low, high


def departure_window(start: DateLike, end: DateLike) -> tuple[datetime, datetime]:
    """Half-open departure interval of the months whose first day lies in the range.

    It selects exactly the rows that a closed filter on the month's first day
    would keep, but on the raw column, so Parquet statistics can skip data.
    """
    low, high = ordered_range(start, end)
    first = low if low.day == 1 else _next_month(low)
    return _midnight(first), _midnight(_next_month(high))


def _next_month(day: date) -> date:
    return (day.replace(day=1) + timedelta(days=32)).replace(day=1)


def _midnight(day: date) -> datetime:
    return datetime(day.year, day.month, day.day)


def in_years(departure: str, first: int, last: int) -> Column:
    """Years first..last, both included, as bounds on the raw timestamp."""
    column = F.col(departure)
    return (column >= F.lit(datetime(first, 1, 1)).cast("timestamp_ntz")) & (
        column < F.lit(datetime(last + 1, 1, 1)).cast("timestamp_ntz")
    )


def iso_weekday(value: Column) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(value) + 1


def day_name(weekday: Column) -> Column:
    pairs = [F.lit(item) for pair in DAY_NAMES.items() for item in pair]
    return F.element_at(F.create_map(*pairs), weekday)


def month_start(value: Column) -> Column:
    return F.trunc(value, "month")


def lenient_date(df: DataFrame, name: str) -> Column:
    """The column as a date: dates stay, timestamps drop the time, other text
    must be a full ISO day and is null otherwise."""
    kind = df.schema[name].dataType
    column = F.col(name)
    if isinstance(kind, T.DateType):
        return column
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return column.cast("date")
    text = F.trim(column.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def add_date_parts(df: DataFrame, name: str) -> DataFrame:
    """Read the column leniently as a date and add year, month and weekday."""
    parsed = df.withColumn(name, lenient_date(df, name))
    day = F.col(name)
    return parsed.withColumns(
        {"year": F.year(day), "month": F.month(day), "weekday": iso_weekday(day)}
    )
