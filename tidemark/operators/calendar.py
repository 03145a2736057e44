"""Date spines, the date dimension and gaps in a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import day_name, iso_dow, month_name, date_key

_STEP = {"day": "interval 1 day", "month": "interval 1 month"}


def date_spine(bounds: DataFrame, start: str = "start", end: str = "end", grain: str = "day") -> DataFrame:
    """Every day or month from ``start`` to ``end`` of a one-row frame, inclusive."""
    days = F.sequence(F.col(start), F.col(end), F.expr(_STEP[grain]))
    return bounds.select(F.explode(days).alias("day"))


def span_of(df: DataFrame, ts: str | Column, grain: str = "day") -> DataFrame:
    """One row with the first and last period present in ``df``."""
    c = F.to_date(F.col(ts) if isinstance(ts, str) else ts)
    c = F.trunc(c, "month") if grain == "month" else c
    return df.agg(F.min(c).alias("start"), F.max(c).alias("end"))


def date_dim(spine: DataFrame, day: str = "day") -> DataFrame:
    """Calendar attributes, keyed by YYYYMMDD."""
    d = F.col(day)
    return spine.select(
        date_key(d).alias("date_key"),
        d.alias("full_date"),
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        month_name(d).alias("month_name"),
        F.weekofyear(d).alias("week"),
        F.dayofmonth(d).alias("day_of_month"),
        iso_dow(d).alias("day_of_week"),
        day_name(d).alias("day_name"),
        (iso_dow(d) >= 6).alias("is_weekend"),
    )


def _periods(df: DataFrame, ts: str, grain: str) -> Column:
    day = F.to_date(F.col(ts))
    return F.trunc(day, "month") if grain == "month" else day


def find_gaps(df: DataFrame, ts: str, grain: str = "day") -> DataFrame:
    """Periods between the first and the last one that hold no row."""
    present = df.select(_periods(df, ts, grain).alias("day")).distinct()
    return date_spine(span_of(df, ts, grain), grain=grain).join(present, "day", "left_anti")


def fill_gaps(df: DataFrame, ts: str, grain: str, zeros: list[str]) -> DataFrame:
    """One row per period of a per-period frame; measures of absent periods are 0."""
    series = df.withColumn("day", _periods(df, ts, grain))
    series = series if ts == "day" else series.drop(ts)
    return date_spine(span_of(df, ts, grain), grain=grain).join(series, "day", "left").fillna(0, subset=zeros)
