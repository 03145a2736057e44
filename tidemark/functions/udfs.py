"""Classification functions, one vectorised function and their SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import _col, bucket

# Region of each place name.
REGION_GROUPS = {
    "AFRICA": "Outer",
    "AMERICA": "Core",
    "ASIA": "Core",
    "EUROPE": "Core",
    "MIDDLE EAST": "Outer",
}


# Upper edges of the distance and fare classes, hours of the times of day, last hours of the parts of a day.
DISTANCES = ((1, "short"), (5, "medium"), (15, "long")), "very_long"
FARES = ((10, "cheap"), (30, "moderate"), (75, "expensive")), "premium"
TIMES = ((6, 9, "morning_rush"), (10, 15, "midday"), (16, 19, "evening_rush"), (20, 23, "evening")), "overnight"
DAY_PARTS = ((3, "late_night"), (6, "early_morning"), (9, "morning_rush"), (15, "midday"), (19, "evening_rush")), "evening"


def distance_class(c: str | Column) -> Column:
    c, (edges, rest) = _col(c), DISTANCES
    return bucket([(c.isNull(), "unknown"), *[(c <= edge, label) for edge, label in edges]], rest)


def region_of(c: str | Column) -> Column:
    """NULL is 'Unknown', an unlisted name is 'Other'."""
    c = _col(c)
    pairs = [F.lit(x) for kv in REGION_GROUPS.items() for x in kv]
    known = F.try_element_at(F.create_map(*pairs), c)
    return F.when(c.isNull(), "Unknown").otherwise(F.coalesce(known, F.lit("Other")))


def time_of_day(hour: str | Column) -> Column:
    hour, (spans, rest) = _col(hour), TIMES
    return F.when(hour.isNotNull(), bucket([(hour.between(a, b), label) for a, b, label in spans], rest))


def fare_class(c: str | Column) -> Column:
    """The first edge is excluded, the others are included."""
    c, (edges, rest) = _col(c), FARES
    (first, label), *more = edges
    return F.when(c.isNotNull(), bucket([(c < first, label), *[(c <= edge, name) for edge, name in more]], rest))


def day_part(hour: str | Column) -> Column:
    """Six parts of the day, finer than :func:`time_of_day`."""
    hour, (edges, rest) = _col(hour), DAY_PARTS
    return F.when(hour.isNotNull(), bucket([(hour <= edge, label) for edge, label in edges], rest))


def tip_pct(tip: str | Column, base: str | Column) -> Column:
    """Built-in twin of :func:`tip_pct_vec`; this is the one to use."""
    tip, base = _col(tip), _col(base)
    return F.when(base != 0, tip / base * 100.0)


@F.pandas_udf(T.DoubleType())
def tip_pct_vec(tip: pd.Series, base: pd.Series) -> pd.Series:
    """Arrow-batched tip percentage; a zero base gives NULL."""
    return tip / base.where(base != 0) * 100.0


def register_functions(spark: SparkSession) -> None:
    """Make the functions callable from SQL; the first two are macros over the same edges, not Python."""
    (edges, far), (spans, other) = DISTANCES, TIMES
    distance = " ".join(f"WHEN d <= {edge} THEN '{label}'" for edge, label in edges)
    time = " ".join(f"WHEN h BETWEEN {a} AND {b} THEN '{label}'" for a, b, label in spans)
    macro = "CREATE OR REPLACE TEMPORARY FUNCTION {} RETURNS STRING RETURN CASE WHEN {} ELSE '{}' END"
    spark.sql(macro.format("distance_class(d DOUBLE)", f"d IS NULL THEN 'unknown' {distance}", far))
    spark.sql(macro.format("time_of_day(h INT)", f"h IS NULL THEN NULL {time}", other))
    spark.udf.register("tip_pct_vec", tip_pct_vec)
