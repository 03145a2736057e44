"""Tables behind dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.amounts import mean, ratio, total
from tidemark.operators.aggregates import pivot


def kpis(df: DataFrame) -> DataFrame:
    """Headline figures in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("trips"),
        total("total").alias("revenue"),
        mean("fare").alias("avg_fare"),
        mean("distance").alias("avg_distance"),
        ratio(F.sum("tip"), F.sum("fare"), 100.0).alias("tip_pct"),
        F.count_distinct("from_nation").alias("active_places"),
    )


def trend(df: DataFrame, ts: str) -> DataFrame:
    """Trips and revenue per day."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("trips"), total("total").alias("revenue")
    )


def breakdown(df: DataFrame, by: str) -> DataFrame:
    """Trips, share and mean fare per category; categories are few, so shares use one window row."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("trips"), mean("fare").alias("avg_fare"))
    everything = out.agg(F.sum("trips").alias("_all"))
    return out.crossJoin(F.broadcast(everything)).withColumn("share", F.col("trips") / F.col("_all")).drop("_all")


def daily_by_region(df: DataFrame, ts: str, regions: list[str]) -> DataFrame:
    """Trips per day with one column per region."""
    return pivot(df.withColumn("day", F.to_date(ts)), ["day"], "from_r_name", regions, F.count(F.lit(1)))


def flow_matrix(df: DataFrame, regions: list[str]) -> DataFrame:
    """Region to region trips as a heat-map table."""
    return pivot(df, ["from_r_name"], "to_r_name", regions, F.count(F.lit(1)))
