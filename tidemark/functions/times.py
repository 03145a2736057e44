"""Time expressions. Day of week is ISO (Monday 1 … Sunday 7) everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import any_of

RUSH_HOURS = ((7, 9), (17, 19))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def minutes_between(start: str | Column, end: str | Column) -> Column:
    return (F.unix_timestamp(_col(end)) - F.unix_timestamp(_col(start))) / F.lit(60)


def minute_boundaries(start: str | Column, end: str | Column) -> Column:
    """How many minute marks lie between two instants (12:00:59 → 12:01:00 is one)."""
    mark = lambda c: F.floor(F.unix_timestamp(_col(c)) / 60)
    return (mark(end) - mark(start)).cast("bigint")


def iso_dow(c: str | Column) -> Column:
    return F.weekday(_col(c)) + 1


def is_weekend(c: str | Column) -> Column:
    return iso_dow(c) >= 6


def day_type(c: str | Column) -> Column:
    return F.when(is_weekend(c), "weekend").otherwise("weekday")


def in_hours(c: str | Column, ranges: Sequence[tuple[int, int]]) -> Column:
    return any_of([F.hour(_col(c)).between(a, b) for a, b in ranges])


def is_rush_hour(c: str | Column, ranges: Sequence[tuple[int, int]] = RUSH_HOURS) -> Column:
    return ~is_weekend(c) & in_hours(c, ranges)


def rush_category(c: str | Column) -> Column:
    hour = F.hour(_col(c))
    weekday = ~is_weekend(c)
    return (
        F.when(weekday & hour.between(*RUSH_HOURS[0]), "morning_rush")
        .when(weekday & hour.between(*RUSH_HOURS[1]), "evening_rush")
        .otherwise("non_rush")
    )


def month_of(c: str | Column) -> Column:
    return F.trunc(F.to_date(_col(c)), "month")


def date_key(c: str | Column) -> Column:
    """YYYYMMDD as an integer."""
    d = F.to_date(_col(c))
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def day_name(c: str | Column) -> Column:
    return F.date_format(F.to_date(_col(c)), "EEEE")


def month_name(c: str | Column) -> Column:
    return F.date_format(F.to_date(_col(c)), "MMMM")


def date_parts(df: DataFrame, ts: str, prefix: str = "") -> DataFrame:
    """Add hour, day-of-week, day and month names, month, quarter, week, year, date, keys."""
    c = F.col(ts)
    return df.withColumns(
        {
            f"{prefix}date": F.to_date(c),
            f"{prefix}hour": F.hour(c),
            f"{prefix}dow": iso_dow(c),
            f"{prefix}day_name": day_name(c),
            f"{prefix}week": F.weekofyear(c),
            f"{prefix}month": F.month(c),
            f"{prefix}month_name": month_name(c),
            f"{prefix}quarter": F.quarter(c),
            f"{prefix}year": F.year(c),
            f"{prefix}month_key": (F.year(c) * 100 + F.month(c)).cast("int"),
            f"{prefix}date_key": date_key(c),
        }
    )
