"""Gold tables over silver rows (started, ended, places, distance, fare, tip, total, ...)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.amounts import mean, mean_ratio, ratio, total
from tidemark.functions.scalars import direction, safe_divide
from tidemark.functions.times import RUSH_HOURS, day_name, day_type, in_hours, iso_dow, rush_category
from tidemark.operators.joins import enrich_roles
from tidemark.operators.sets import top_k
from tidemark.operators.windows import moving_avg

def trips() -> Column:
    return F.count(F.lit(1)).alias("trips")


def daily_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Volume, revenue and averages per day, optionally per source."""
    return df.groupBy("day", *by).agg(
        trips(),
        total("total").alias("revenue"),
        mean("distance").alias("avg_distance"),
        mean("tip").alias("avg_tip"),
        (F.count_if("is_hub") / F.count(F.lit(1)) * 100).alias("hub_pct"),
    )


def with_weekly_averages(daily: DataFrame) -> DataFrame:
    """Seven-day moving averages over one row per day."""
    out = moving_avg(daily, [], ["day"], "trips", 7, "trips_7d")
    cents = out.withColumn("_cents", F.col("revenue").cast("decimal(20,2)"))
    return moving_avg(cents, [], ["day"], "_cents", 7, "revenue_7d").drop("_cents")


def daily_by_zone(df: DataFrame, zone: str) -> DataFrame:
    """One row per day, place and source: the base of the marts."""
    return df.groupBy("day", zone, "source").agg(
        trips(),
        F.count_distinct("to_nation").alias("targets"),
        F.sum("total").alias("revenue"),
        mean("distance").cast("decimal(24,8)").alias("avg_distance"),
        F.count_if("is_hub").alias("hub_trips"),
    )


def daily_mart(by_zone: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Per day: sums, the unweighted mean of zone means, and trips per source as columns."""
    return by_zone.groupBy("day").agg(
        F.sum("trips").alias("trips"),
        F.round(F.sum("revenue"), 2).cast("double").alias("revenue"),
        mean("avg_distance").alias("avg_distance"),
        F.sum("hub_trips").alias("hub_trips"),
        *[F.sum(F.when(F.col("source") == s, F.col("trips")).otherwise(0)).alias(f"{s}_trips") for s in sources],
        ratio(F.sum("revenue"), F.sum("trips")).alias("revenue_per_trip"),
    )


def zone_mart(by_zone: DataFrame, zone: str) -> DataFrame:
    """Per place: activity, revenue and rank by volume."""
    out = by_zone.groupBy(zone).agg(
        F.count_distinct("day").alias("active_days"),
        F.sum("trips").alias("trips"),
        F.round(F.sum("revenue"), 2).cast("double").alias("revenue"),
        ratio(F.sum("trips"), F.count(F.lit(1))).alias("avg_daily_trips"),
        ratio(F.sum("hub_trips"), F.sum("trips"), 100.0).alias("hub_pct"),
    )
    return out.withColumn("volume_rank", F.rank().over(Window.partitionBy().orderBy(F.col("trips").desc())))


def hourly_profile(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Volume and mean value by hour and day type."""
    return df.groupBy(F.hour(ts).alias("hour"), day_type(ts).alias("day_type")).agg(trips(), mean(value).alias("avg_value"))


def rush_profile(df: DataFrame, ts: str, value: str) -> DataFrame:
    return df.groupBy(rush_category(ts).alias("rush")).agg(trips(), mean(value).alias("avg_value"))


def weekday_profile(df: DataFrame, ts: str, value: str) -> DataFrame:
    return df.groupBy(iso_dow(ts).alias("dow"), day_name(ts).alias("day_name")).agg(
        trips(), total(value).alias("sum_value"), mean(value).alias("avg_value")
    )


def rush_versus_weekend(df: DataFrame, ts: str, value: str) -> DataFrame:
    """The rush hours on weekdays against the same hours at weekends."""
    return df.filter(in_hours(ts, RUSH_HOURS)).groupBy(day_type(ts).alias("day_type")).agg(
        trips(), mean(value).alias("avg_value")
    )


def hour_heatmap(df: DataFrame, ts: str, value: str) -> DataFrame:
    return df.groupBy(iso_dow(ts).alias("dow"), F.hour(ts).alias("hour")).agg(trips(), mean(value).alias("avg_value"))


def with_places(df: DataFrame, places: DataFrame) -> DataFrame:
    """Names and regions of both ends."""
    return enrich_roles(df, places, "n_nationkey", {"from": "from_nation", "to": "to_nation"})


def zone_performance(df: DataFrame, role: str) -> DataFrame:
    return df.groupBy(f"{role}_r_name", f"{role}_n_name").agg(
        trips(), total("total").alias("revenue"), mean("distance").alias("avg_distance"), mean("fare").alias("avg_fare")
    )


def region_revenue(df: DataFrame) -> DataFrame:
    return df.groupBy("from_r_name").agg(
        trips(), total("total").alias("revenue"), mean("total").alias("avg_total"), mean("tip").alias("avg_tip")
    )


def od_matrix(df: DataFrame, k: int) -> DataFrame:
    """The ``k`` busiest origin–destination pairs."""
    pairs = df.groupBy("from_n_name", "to_n_name").agg(
        trips(), mean("total").alias("avg_total"), mean("distance").alias("avg_distance")
    )
    return top_k(pairs, [F.col("trips").desc(), "from_n_name", "to_n_name"], k)


def cross_region(df: DataFrame, k: int) -> DataFrame:
    """Busiest flows between different regions."""
    flows = df.filter("from_r_name <> to_r_name").groupBy("from_r_name", "to_r_name").agg(
        trips(), mean("fare").alias("avg_fare"), mean("distance").alias("avg_distance")
    )
    return top_k(flows, [F.col("trips").desc(), "from_r_name", "to_r_name"], k)


def top_routes(df: DataFrame, k: int, support: int = 0) -> DataFrame:
    """Most profitable routes with at least ``support`` trips."""
    routes = df.groupBy("from_n_name", "to_n_name").agg(
        trips(), total("total").alias("revenue"), mean("fare").alias("avg_fare")
    ).filter(F.col("trips") >= support)
    return top_k(routes, [F.col("revenue").desc(), "from_n_name", "to_n_name"], k)


def slow_zones(df: DataFrame, limit: float) -> DataFrame:
    """Places whose distance over time stays below ``limit`` per hour."""
    sums = df.filter("duration_min > 0").groupBy("from_n_name").agg(
        trips(), ratio(F.sum("distance"), F.sum("duration_min"), 60.0).alias("avg_speed")
    )
    return sums.filter(F.col("avg_speed") < limit)


def day_type_compare(df: DataFrame, ts: str) -> DataFrame:
    """Weekday against weekend, with trips per active day."""
    return df.groupBy(day_type(ts).alias("day_type")).agg(
        trips(),
        mean("fare").alias("avg_fare"),
        mean("distance").alias("avg_distance"),
        ratio(F.sum("tip"), F.sum("fare"), 100.0).alias("tip_pct"),
        (F.count(F.lit(1)) / F.count_distinct(F.to_date(ts))).alias("trips_per_day"),
    )


def factor_join(daily: DataFrame, factors: DataFrame, buckets: Mapping[str, Column]) -> DataFrame:
    """Daily facts with an outside factor of the same day, bucketed."""
    return daily.join(factors, "day").withColumns(dict(buckets))


def factor_impact(joined: DataFrame, bucket: str, measures: Sequence[str]) -> DataFrame:
    """Days and mean of each measure per bucket."""
    return joined.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("days"),
        *[mean(F.col(m).cast("decimal(24,6)")).alias(f"avg_{m}") for m in measures],
    )


def factor_premium(joined: DataFrame, exposed: Column, measure: str) -> DataFrame:
    """Mean on exposed and other days, and the difference in percent."""
    c = F.col(measure).cast("decimal(24,6)")
    out = joined.agg(
        mean(F.when(exposed, c)).alias("exposed_mean"), mean(F.when(~F.coalesce(exposed, F.lit(False)), c)).alias("other_mean")
    )
    gap = (F.col("exposed_mean") - F.col("other_mean")) / F.col("other_mean") * 100
    return out.withColumn("premium_pct", F.when(F.col("other_mean") != 0, gap))


def compare_sources(df: DataFrame, source: str) -> DataFrame:
    """One line per source: volume, mean duration and mean fare (NULL where a source has none)."""
    return df.groupBy(source).agg(trips(), mean("duration_min").alias("avg_duration"), mean("fare").alias("avg_fare"))


def payment_breakdown(df: DataFrame, by: str) -> DataFrame:
    """Tips by payment: mean, mean of ratios, ratio of sums, share of trips with any tip."""
    each = safe_divide(F.col("tip").cast("double"), F.col("fare").cast("double"), 0.0)
    return df.groupBy(by).agg(
        trips(),
        mean("tip").alias("avg_tip"),
        (mean_ratio(each) * 100).alias("avg_tip_pct"),
        ratio(F.sum("tip"), F.sum("fare"), 100.0).alias("tip_pct_of_sums"),
        (F.count_if(F.col("tip") > 0) / F.count(F.lit(1)) * 100).alias("pct_with_tip"),
        mean("distance").alias("avg_distance"),
    )


def endpoint_volume(df: DataFrame, hubs: Sequence[int]) -> DataFrame:
    """Traffic from and to the hub places."""
    way = direction("from_nation", "to_nation", hubs)
    hub = F.when(F.col("from_nation").isin(*hubs), F.col("from_nation")).otherwise(F.col("to_nation"))
    return (
        df.withColumn("way", way).filter("way is not null").groupBy(hub.alias("hub"), "way")
        .agg(trips(), mean("fare").alias("avg_fare"), mean("tip").alias("avg_tip"), mean("distance").alias("avg_distance"))
    )


def origins_of(df: DataFrame, target: int, k: int) -> DataFrame:
    """Places most trips to one target start from."""
    found = df.filter(F.col("to_nation") == target).groupBy("from_r_name", "from_n_name").agg(
        trips(), mean("fare").alias("avg_fare")
    )
    return top_k(found, [F.col("trips").desc(), "from_n_name"], k)


def return_targets(df: DataFrame) -> DataFrame:
    """For each place, where the trips leaving it most often end."""
    flows = df.groupBy("from_n_name", "to_n_name").agg(trips())
    best = F.min(F.struct((-F.col("trips")).alias("neg"), F.col("to_n_name").alias("name")))
    return flows.groupBy("from_n_name").agg(best.alias("_b")).select(
        "from_n_name", F.col("_b.name").alias("main_target"), (-F.col("_b.neg")).alias("trips")
    )
