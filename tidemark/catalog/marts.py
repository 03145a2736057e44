"""Silver, gold, star schema and the end-to-end run."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.aggregates import DAILY, daily_figures, placed
from tidemark.catalog.base import EV, NATIONS, PLACED, SALES, events, hash_key, mean, mean_over, mean_ratio, query, total
from tidemark.catalog.scalars import HUBS, ended_events
from tidemark.functions.amounts import mean as avg_money
from tidemark.functions.scalars import bucket
from tidemark.functions.times import day_type
from tidemark.operators.aggregates import correlations, min_support
from tidemark.operators.sets import stack_by_name
from tidemark.operators.windows import agg_rank, top_n_per
from tidemark.plans import gold as G
from tidemark.plans.medallion import run_medallion
from tidemark.plans.partials import Measure, PartialStore
from tidemark.plans.silver import SilverSpec, accounting, silver
from tidemark.plans.star import build_fact, with_row_id
from tidemark.scratch import materialise, scratch_path
from tidemark.tables import nations, sales, table

COLUMNS = ("started", "ended", "from_nation", "to_nation", "distance", "fare", "tip", "total", "payment", "vendor", "order_key", "line_no")
KEYS = ("started", "ended", "from_nation", "to_nation", "fare")
ORDER = ("order_key", "line_no", "distance", "tip", "total", "payment", "vendor")


def trip_spec(tag: str, **extra: Column) -> SilverSpec:
    return SilverSpec(
        tag=tag, mapping={c: c for c in COLUMNS}, keys=KEYS, order=ORDER, not_negative=("fare", "total"),
        hubs=HUBS, minutes=(0.5, 1_000_000), extra=extra,
    )


def street(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return silver(sales(spark, sf_dir).filter("rate = 'A'"), trip_spec("street"))


def hail(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    label = bucket([(F.col("vendor") == "O", "street_hail"), (F.col("vendor") == "F", "dispatch")], "unknown")
    return silver(sales(spark, sf_dir).filter("rate = 'R'"), trip_spec("hail", trip_kind=label))


def _silver_sql(name: str, rate: str) -> str:
    return f"""{name}_rows AS (SELECT *, '{name}' AS source, CAST(started AS DATE) AS day, (epoch(ended) - epoch(started)) / 60 AS duration_min,
  from_nation IN (1, 7, 13) OR to_nation IN (1, 7, 13) AS is_hub FROM (SELECT *, row_number() OVER
  (PARTITION BY started, ended, from_nation, to_nation, fare ORDER BY order_key, line_no, distance, tip, total, payment, vendor) AS rn
  FROM sales WHERE rate = '{rate}' AND fare >= 0 AND total >= 0) WHERE rn = 1),
{name}_all AS (SELECT *, CASE WHEN duration_min > 0 THEN distance / (duration_min / 60) END AS speed,
  duration_min BETWEEN 0.5 AND 1000000 AS ok FROM {name}_rows), {name} AS (SELECT * FROM {name}_all WHERE ok)"""


STREET, HAIL = _silver_sql("street", "A"), _silver_sql("hail", "R")
BOTH = f"{SALES}, {STREET}, {HAIL}, trips_all AS (SELECT * FROM street UNION ALL SELECT * FROM hail)"


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows of the two trip sources, from one pass: the source is derived from the rate and part of the key."""
    source = bucket([(F.col("rate") == "A", "street"), (F.col("rate") == "R", "hail")], "none")
    spec = replace(trip_spec("both"), tag=source, keys=(*KEYS, "source"))
    return silver(sales(spark, sf_dir).filter("rate IN ('A', 'R')"), spec)[0]


@query(f"""WITH {SALES}, r AS (SELECT *, CASE WHEN order_key % 11 = 0 THEN NULL ELSE ended END AS e, CASE WHEN order_key % 13 = 0 THEN -fare ELSE fare END AS f FROM sales),
s AS (SELECT *, CASE WHEN e IS NULL OR started IS NULL THEN 'missing_time' WHEN f < 0 THEN 'negative_fare' WHEN total < 0 THEN 'negative_total' END AS rule,
  (epoch(e) - epoch(started)) / 60 AS minutes FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY rule, started, e, from_nation, to_nation, f ORDER BY order_key, line_no) AS rn FROM s)
SELECT CASE WHEN rule IS NOT NULL THEN 'dropped' WHEN rn > 1 THEN 'duplicate' WHEN minutes BETWEEN 0.5 AND 100000 THEN 'valid' ELSE 'quarantine' END AS outcome,
CASE WHEN rule IS NOT NULL THEN rule WHEN rn = 1 AND NOT minutes BETWEEN 0.5 AND 100000 THEN 'duration' END AS rule, COUNT(*) AS rows
FROM (SELECT * FROM k UNION ALL SELECT * REPLACE (rn + 1 AS rn) FROM k WHERE order_key % 17 = 0) GROUP BY ALL""")
def silver_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows lack their end, have negative money or come twice: raw = valid + quarantine + duplicates + dropped."""
    df = sales(spark, sf_dir)
    ended = F.when(F.col("order_key") % 11 != 0, F.col("ended"))
    fare = F.when(F.col("order_key") % 13 == 0, -F.col("fare")).otherwise(F.col("fare"))
    raw = df.withColumns({"ended": ended, "fare": fare})
    raw = raw.withColumn("_copy", F.explode(F.when(F.col("order_key") % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return accounting(raw, replace(trip_spec("trips"), minutes=(0.5, 100_000)))


@query(f"""WITH {SALES}, {STREET} SELECT CASE WHEN ok THEN 'valid' ELSE 'quarantine' END AS part, is_hub, COUNT(*) AS rows,
{total('total')} AS revenue, MAX(speed) AS max_speed FROM street_all GROUP BY ALL""")
def silver_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, bad = street(spark, sf_dir)
    marked = stack_by_name([valid.withColumn("part", F.lit("valid")), bad.withColumn("part", F.lit("quarantine"))])
    return marked.groupBy("part", "is_hub").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("total"), 2).cast("double").alias("revenue"), F.max("speed").alias("max_speed")
    )


@query(f"""WITH {SALES}, {HAIL} SELECT CASE vendor WHEN 'O' THEN 'street_hail' WHEN 'F' THEN 'dispatch' ELSE 'unknown' END AS trip_kind,
COUNT(*) AS rows, {total('total')} AS revenue FROM hail GROUP BY 1""")
def silver_hail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hail(spark, sf_dir)[0].groupBy("trip_kind").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("total"), 2).cast("double").alias("revenue")
    )


# Companies behind event types.
COMPANIES = {"click": "North", "view": "South", "purchase": "East"}


@query("""WITH e AS (SELECT event_type, ts, user_id, value, ts + to_seconds(CAST(round(value * 60) AS BIGINT)) AS ended FROM events),
d AS (SELECT DISTINCT ts, ended, user_id, event_type FROM e), m AS (SELECT *, (floor(epoch(ended)) - floor(epoch(ts))) / 60 AS minutes,
  isodow(ts) < 6 AND (hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19) AS is_rush FROM d)
SELECT CASE event_type WHEN 'click' THEN 'North' WHEN 'view' THEN 'South' WHEN 'purchase' THEN 'East' ELSE 'Other' END AS company,
CASE WHEN minutes BETWEEN 0.5 AND 20 THEN 'valid' ELSE 'quarantine' END AS part, is_rush, COUNT(*) AS rows FROM m GROUP BY ALL""")
def silver_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source without money: events as rides, labelled by company."""
    company = bucket([(F.col("kind") == k, v) for k, v in COMPANIES.items()], "Other")
    spec = SilverSpec(
        tag="app", mapping={"started": "ts", "ended": "ended", "rider": "user_id", "kind": "event_type", "ride": "event_id"},
        keys=("started", "ended", "rider", "kind"), order=("ride",), has_distance=False, minutes=(0.5, 20), extra={"company": company},
    )
    valid, bad = silver(ended_events(spark, sf_dir), spec)
    marked = stack_by_name([valid.withColumn("part", F.lit("valid")), bad.withColumn("part", F.lit("quarantine"))])
    return marked.groupBy("company", "part", "is_rush").agg(F.count(F.lit(1)).alias("rows"))


_FACT = f"""SELECT {hash_key('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} AS fact_key,
CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS order_date_key, CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS ship_date_key,
o_custkey AS customer_key, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate AND l_extendedprice >= 0"""


@query(_FACT)
def build_sales_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return build_fact(
        lines, {"customer_key": "o_custkey", "quantity": "l_quantity"},
        {"order_date_key": "o_orderdate", "ship_date_key": "l_shipdate"},
        (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_extendedprice") >= 0),
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    )


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS row_id FROM customer")
def surrogate_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_id(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"])


_DAILY = f"""COUNT(*) AS trips, {total('total')} AS revenue, {mean('distance')} AS avg_distance, {mean('tip')} AS avg_tip,
COUNT(*) FILTER (WHERE is_hub) / COUNT(*) * 100 AS hub_pct"""


@query(f"WITH {BOTH} SELECT day, source, {_DAILY} FROM trips_all GROUP BY day, source")
def gold_daily_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.daily_metrics(both(spark, sf_dir), ["source"])


@query(f"""WITH {BOTH}, d AS (SELECT day, {_DAILY} FROM trips_all GROUP BY day)
SELECT *, {mean_over('trips', 'ORDER BY day ROWS 6 PRECEDING')} AS trips_7d,
{mean_over('CAST(revenue AS DECIMAL(20,2))', 'ORDER BY day ROWS 6 PRECEDING')} AS revenue_7d FROM d""")
def gold_daily_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_weekly_averages(G.daily_metrics(both(spark, sf_dir)))


def _in_rounds(store: PartialStore, rows: DataFrame) -> None:
    """Refresh the periods up to 1995, those of 1996 and 1997, the rest, and the middle ones once more."""
    year = F.year(store.period)
    for part in (year < 1996, year.isin(1996, 1997), year > 1997, year == 1997):
        store.refresh(rows.filter(part))


@query(f"""WITH {BOTH}, d AS (SELECT day, {_DAILY} FROM trips_all GROUP BY day)
SELECT *, {mean_over('trips', 'ORDER BY day ROWS 6 PRECEDING')} AS trips_7d,
{mean_over('CAST(revenue AS DECIMAL(20,2))', 'ORDER BY day ROWS 6 PRECEDING')} AS revenue_7d FROM d""")
def gold_daily_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily table folded from states that were refreshed in rounds."""
    rows = materialise(both(spark, sf_dir).withColumn("month", F.trunc("day", "month")), "trips")
    one = F.lit(1)
    store = PartialStore(spark, scratch_path(spark, "gold-daily"), "month", ["day", "source"], {
        "trips": Measure("count", one), "revenue": Measure("sum", F.col("total")), "avg_distance": Measure("mean", F.col("distance")),
        "avg_tip": Measure("mean", F.col("tip")), "hubs": Measure("count", F.when(F.col("is_hub"), one)),
    })
    _in_rounds(store, rows)
    daily = store.fold({"day": F.col("day")}).select(
        "day", "trips", F.round("revenue", 2).cast("double").alias("revenue"), "avg_distance", "avg_tip",
        (F.col("hubs") / F.col("trips") * 100).alias("hub_pct"))
    return G.with_weekly_averages(daily)


@query(f"""WITH {BOTH}, z AS (SELECT * FROM trips_all WHERE day >= DATE '1996-01-01')
SELECT from_nation, CAST(year(day) AS INTEGER) AS year, COUNT(*) AS trips, COUNT(DISTINCT to_nation) AS targets, COUNT(DISTINCT order_key) AS orders,
CAST(MIN(fare) AS DOUBLE) AS min_fare, CAST(MAX(fare) AS DOUBLE) AS max_fare, {total('fare')} AS sum_fare, TRUE AS near FROM z GROUP BY ALL""")
def gold_zones_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by year from monthly states, with exact and estimated distinct counts."""
    rows = materialise(both(spark, sf_dir).withColumn("month", F.trunc("day", "month")), "trips")
    fare = F.col("fare")
    store = PartialStore(spark, scratch_path(spark, "gold-zones"), "month", ["from_nation"], {
        "trips": Measure("count", F.lit(1)), "targets": Measure("distinct", F.col("to_nation")), "orders": Measure("distinct", F.col("order_key")),
        "about_orders": Measure("about_distinct", F.col("order_key")), "min_fare": Measure("min", fare), "max_fare": Measure("max", fare),
        "sum_fare": Measure("sum", fare),
    })
    _in_rounds(store, rows)
    by = {"from_nation": F.col("from_nation"), "year": F.year("month")}
    out = store.fold(by, F.col("month") >= F.lit("1996-01-01").cast("date"))
    money = {c: F.col(c).cast("double") for c in ("min_fare", "max_fare")} | {"sum_fare": F.round("sum_fare", 2).cast("double")}
    near = F.abs(F.col("about_orders") - F.col("orders")) <= 0.1 * F.col("orders") + 1
    return out.withColumns({**money, "near": near}).drop("about_orders")


_ZONE_DAY = f"""{BOTH}, z AS (SELECT day, from_nation, source, COUNT(*) AS trips, COUNT(DISTINCT to_nation) AS targets, SUM(total) AS revenue,
  CAST({mean('distance')} AS DECIMAL(24,8)) AS avg_distance, COUNT(*) FILTER (WHERE is_hub) AS hub_trips FROM trips_all GROUP BY day, from_nation, source)"""


@query(f"""WITH {_ZONE_DAY} SELECT day, from_nation, source, trips, targets, CAST(ROUND(revenue, 2) AS DOUBLE) AS revenue,
CAST(avg_distance AS DOUBLE) AS avg_distance, hub_trips FROM z""")
def mart_zone_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = G.daily_by_zone(both(spark, sf_dir), "from_nation")
    return df.withColumns({"revenue": F.round("revenue", 2).cast("double"), "avg_distance": F.col("avg_distance").cast("double")})


@query(f"""WITH {_ZONE_DAY} SELECT day, CAST(SUM(trips) AS BIGINT) AS trips, {total('revenue')} AS revenue, {mean('avg_distance')} AS avg_distance,
CAST(SUM(hub_trips) AS BIGINT) AS hub_trips, CAST(SUM(CASE WHEN source = 'street' THEN trips ELSE 0 END) AS BIGINT) AS street_trips,
CAST(SUM(CASE WHEN source = 'hail' THEN trips ELSE 0 END) AS BIGINT) AS hail_trips, CAST(SUM(revenue) AS DOUBLE) / CAST(SUM(trips) AS DOUBLE) AS revenue_per_trip
FROM z GROUP BY day""")
def mart_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.daily_mart(G.daily_by_zone(both(spark, sf_dir), "from_nation"), ["street", "hail"])


@query(f"""WITH {_ZONE_DAY}, g AS (SELECT from_nation, COUNT(DISTINCT day) AS active_days, CAST(SUM(trips) AS BIGINT) AS trips, {total('revenue')} AS revenue,
CAST(SUM(trips) AS DOUBLE) / COUNT(*) AS avg_daily_trips, CAST(SUM(hub_trips) AS DOUBLE) / CAST(SUM(trips) AS DOUBLE) * 100 AS hub_pct FROM z GROUP BY from_nation)
SELECT *, CAST(rank() OVER (ORDER BY trips DESC) AS INTEGER) AS volume_rank FROM g""")
def mart_zone_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.zone_mart(G.daily_by_zone(both(spark, sf_dir), "from_nation"), "from_nation")


_TYPE = "CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END"


@query(f"WITH {EV} SELECT CAST(hour(ts) AS INTEGER) AS hour, {_TYPE} AS day_type, COUNT(*) AS trips, {mean('value')} AS avg_value FROM ev GROUP BY ALL")
def gold_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hourly_profile(events(spark, sf_dir), "ts", "value")


@query(f"""WITH {EV} SELECT CASE WHEN isodow(ts) < 6 AND hour(ts) BETWEEN 7 AND 9 THEN 'morning_rush'
WHEN isodow(ts) < 6 AND hour(ts) BETWEEN 17 AND 19 THEN 'evening_rush' ELSE 'non_rush' END AS rush, COUNT(*) AS trips, {mean('value')} AS avg_value FROM ev GROUP BY ALL""")
def gold_rush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rush_profile(events(spark, sf_dir), "ts", "value")


@query(f"""WITH {EV} SELECT CAST(isodow(ts) AS INTEGER) AS dow, dayname(ts) AS day_name, COUNT(*) AS trips, {total('value')} AS sum_value,
{mean('value')} AS avg_value FROM ev GROUP BY ALL""")
def gold_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.weekday_profile(events(spark, sf_dir), "ts", "value")


@query(f"""WITH {EV} SELECT {_TYPE} AS day_type, COUNT(*) AS trips, {mean('value')} AS avg_value FROM ev
WHERE hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19 GROUP BY ALL""")
def gold_rush_versus_weekend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rush_versus_weekend(events(spark, sf_dir), "ts", "value")


@query(f"WITH {EV} SELECT CAST(isodow(ts) AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS hour, COUNT(*) AS trips, {mean('value')} AS avg_value FROM ev GROUP BY ALL")
def gold_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hour_heatmap(events(spark, sf_dir), "ts", "value")


@query(f"""WITH {PLACED} SELECT from_r_name, from_n_name, COUNT(*) AS trips, {total('total')} AS revenue, {mean('distance')} AS avg_distance, {mean('fare')} AS avg_fare
FROM placed GROUP BY ALL""")
def gold_pickup_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.zone_performance(placed(spark, sf_dir), "from")


@query(f"""WITH {PLACED} SELECT to_r_name, to_n_name, COUNT(*) AS trips, {total('total')} AS revenue, {mean('distance')} AS avg_distance, {mean('fare')} AS avg_fare
FROM placed GROUP BY ALL""")
def gold_dropoff_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.zone_performance(placed(spark, sf_dir), "to")


@query(f"""WITH {PLACED} SELECT from_r_name, COUNT(*) AS trips, {total('total')} AS revenue, {mean('total')} AS avg_total, {mean('tip')} AS avg_tip FROM placed GROUP BY ALL""")
def gold_region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.region_revenue(placed(spark, sf_dir))


@query(f"""WITH {PLACED} SELECT from_n_name, to_n_name, COUNT(*) AS trips, {mean('total')} AS avg_total, {mean('distance')} AS avg_distance
FROM placed GROUP BY ALL ORDER BY trips DESC, from_n_name, to_n_name LIMIT 100""")
def gold_od_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.od_matrix(placed(spark, sf_dir), 100)


@query(f"""WITH {PLACED} SELECT from_r_name, to_r_name, COUNT(*) AS trips, {mean('fare')} AS avg_fare, {mean('distance')} AS avg_distance FROM placed
WHERE from_r_name <> to_r_name GROUP BY ALL ORDER BY trips DESC, from_r_name, to_r_name LIMIT 15""")
def gold_cross_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cross_region(placed(spark, sf_dir), 15)


@query(f"""WITH {PLACED} SELECT from_n_name, to_n_name, COUNT(*) AS trips, {total('total')} AS revenue, {mean('fare')} AS avg_fare FROM placed
GROUP BY ALL HAVING COUNT(*) >= 5 ORDER BY revenue DESC, from_n_name, to_n_name LIMIT 5""")
def gold_top_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_routes(placed(spark, sf_dir), 5, 5)


@query(f"""WITH {PLACED} SELECT from_n_name, COUNT(*) AS trips, CAST(SUM(distance) AS DOUBLE) / CAST(SUM((epoch(ended) - epoch(started)) / 60) AS DOUBLE) * 60 AS avg_speed
FROM placed WHERE ended > started GROUP BY ALL HAVING CAST(SUM(distance) AS DOUBLE) / CAST(SUM((epoch(ended) - epoch(started)) / 60) AS DOUBLE) * 60 < 0.0013""")
def gold_slow_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = placed(spark, sf_dir).withColumn("duration_min", (F.unix_timestamp("ended") - F.unix_timestamp("started")) / 60)
    return G.slow_zones(timed, 0.0013)


@query(f"""WITH {SALES} SELECT CASE WHEN isodow(started) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, COUNT(*) AS trips, {mean('fare')} AS avg_fare,
{mean('distance')} AS avg_distance, CAST(SUM(tip) AS DOUBLE) / CAST(SUM(fare) AS DOUBLE) * 100 AS tip_pct,
COUNT(*) / COUNT(DISTINCT CAST(started AS DATE)) AS trips_per_day FROM sales GROUP BY 1""")
def gold_day_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.day_type_compare(sales(spark, sf_dir), "started")


@query(f"""WITH {PLACED}, m AS (SELECT CAST(date_trunc('month', started) AS DATE) AS month, from_r_name, {total('total')} AS revenue FROM placed GROUP BY ALL)
SELECT *, CAST(rank() OVER (PARTITION BY month ORDER BY revenue DESC) AS INTEGER) AS place FROM m""")
def regions_ranked_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc(F.to_date("started"), "month").alias("month")
    revenue = F.round(F.sum("total"), 2).cast("double")
    return agg_rank(placed(spark, sf_dir), [month, "from_r_name"], revenue, "revenue", ["month"])


@query(f"""WITH {PLACED} SELECT from_r_name, CASE WHEN isodow(started) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, COUNT(*) AS rows, {mean('fare')} AS avg_fare
FROM placed GROUP BY ALL HAVING COUNT(*) >= 100""")
def supported_region_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = placed(spark, sf_dir).withColumn("day_type", day_type("started"))
    return min_support(df, ["from_r_name", "day_type"], 100, {"avg_fare": avg_money("fare")})


def factor_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily volume of the other events with the day's error level."""
    daily = daily_figures(spark, sf_dir)
    factors = daily.select("day", F.col("errors").alias("level"))
    level = bucket([(F.col("level") == 0, "none"), (F.col("level") <= 2, "light"), (F.col("level") <= 60, "moderate")], "heavy")
    return G.factor_join(daily.select("day", "rows", "users", "sum_value"), factors, {"band": level})


_BANDED = f"""{DAILY}, j AS (SELECT day, rows, users, sum_value, errors AS level, CASE WHEN errors = 0 THEN 'none' WHEN errors <= 2 THEN 'light'
WHEN errors <= 60 THEN 'moderate' ELSE 'heavy' END AS band FROM daily)"""


@query(f"""WITH {_BANDED} SELECT band, COUNT(*) AS days, {mean('CAST(rows AS DECIMAL(24,6))')} AS avg_rows, {mean('CAST(users AS DECIMAL(24,6))')} AS avg_users,
{mean('CAST(sum_value AS DECIMAL(24,6))')} AS avg_sum_value FROM j GROUP BY band""")
def factor_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.factor_impact(factor_days(spark, sf_dir), "band", ["rows", "users", "sum_value"])


@query(f"""WITH {_BANDED}, m AS (SELECT {mean("CASE WHEN level > 2 THEN CAST(rows AS DECIMAL(24,6)) END")} AS exposed_mean,
{mean("CASE WHEN NOT level > 2 THEN CAST(rows AS DECIMAL(24,6)) END")} AS other_mean FROM j)
SELECT *, CASE WHEN other_mean <> 0 THEN (exposed_mean - other_mean) / other_mean * 100 END AS premium_pct FROM m""")
def factor_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.factor_premium(factor_days(spark, sf_dir), F.col("level") > 2, "rows")


@query(f"""WITH {_BANDED} SELECT 'level' AS x, 'rows' AS y, round(corr(level, rows), 8) AS correlation FROM j
UNION ALL SELECT 'level', 'sum_value', round(corr(level, sum_value), 8) FROM j""")
def factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = correlations(factor_days(spark, sf_dir), ["level"], ["rows", "sum_value"])
    return out.withColumn("correlation", F.round("correlation", 8))


@query(f"""WITH {SALES} SELECT rate, COUNT(*) AS trips, CAST(SUM((epoch(ended) - epoch(started)) / 60) AS DOUBLE) / COUNT(*) AS avg_duration,
{mean("CASE WHEN rate <> 'N' THEN fare END")} AS avg_fare FROM sales GROUP BY rate""")
def compare_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three services, one of which records no fares."""
    df = sales(spark, sf_dir).withColumns(
        {
            "duration_min": (F.unix_timestamp("ended") - F.unix_timestamp("started")) / 60,
            "fare": F.when(F.col("rate") != "N", F.col("fare")),
        }
    )
    return G.compare_sources(df, "rate")


@query(f"""WITH {PLACED}, z AS (SELECT rate, from_n_name, COUNT(*) AS trips FROM placed GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rate ORDER BY trips DESC, from_n_name) AS INTEGER) AS place FROM z) WHERE place <= 10""")
def top_zones_per_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = placed(spark, sf_dir).groupBy("rate", "from_n_name").agg(F.count(F.lit(1)).alias("trips"))
    return top_n_per(z, ["rate"], [F.col("trips").desc(), "from_n_name"], 10, ties=False)


_EACH = "CASE WHEN fare <> 0 THEN CAST(tip AS DOUBLE) / CAST(fare AS DOUBLE) ELSE 0 END"


@query(f"""WITH {SALES} SELECT payment, COUNT(*) AS trips, {mean('tip')} AS avg_tip, {mean_ratio(_EACH, ' * 100')} AS avg_tip_pct,
CAST(SUM(tip) AS DOUBLE) / CAST(SUM(fare) AS DOUBLE) * 100 AS tip_pct_of_sums, COUNT(*) FILTER (WHERE tip > 0) / COUNT(*) * 100 AS pct_with_tip,
{mean('distance')} AS avg_distance FROM sales GROUP BY payment""")
def payment_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.payment_breakdown(sales(spark, sf_dir), "payment").withColumn("avg_tip_pct", F.round("avg_tip_pct", 9))


@query(f"""WITH {SALES} SELECT CASE WHEN from_nation IN (1, 7, 13) THEN from_nation ELSE to_nation END AS hub,
CASE WHEN from_nation IN (1, 7, 13) THEN 'From' ELSE 'To' END AS way, COUNT(*) AS trips, {mean('fare')} AS avg_fare, {mean('tip')} AS avg_tip,
{mean('distance')} AS avg_distance FROM sales WHERE from_nation IN (1, 7, 13) OR to_nation IN (1, 7, 13) GROUP BY ALL""")
def hub_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.endpoint_volume(sales(spark, sf_dir), HUBS)


@query(f"""WITH {PLACED} SELECT from_r_name, from_n_name, COUNT(*) AS trips, {mean('fare')} AS avg_fare FROM placed WHERE to_nation = 7
GROUP BY ALL ORDER BY trips DESC, from_n_name LIMIT 15""")
def origins_of_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.origins_of(placed(spark, sf_dir), 7, 15)


@query(f"""WITH {PLACED}, f AS (SELECT from_n_name, to_n_name, COUNT(*) AS trips FROM placed GROUP BY ALL)
SELECT from_n_name, to_n_name AS main_target, trips FROM (SELECT *, row_number() OVER (PARTITION BY from_n_name ORDER BY trips DESC, to_n_name) AS rn FROM f) WHERE rn = 1""")
def main_return_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.return_targets(placed(spark, sf_dir))


_MEDALLION = _silver_sql("trips", "A").replace("rate = 'A' AND ", "")


@query(f"""WITH {SALES}, {NATIONS}, {_MEDALLION} SELECT 'bronze' AS layer, 'trips' AS table_name, COUNT(*) AS rows FROM sales
UNION ALL SELECT 'bronze', 'places', COUNT(*) FROM nations UNION ALL SELECT 'silver', 'trips', COUNT(*) FROM trips
UNION ALL SELECT 'silver', 'quarantine', COUNT(*) FROM trips_all WHERE NOT ok
UNION ALL SELECT 'gold', 'daily_metrics', COUNT(DISTINCT day) FROM trips UNION ALL SELECT 'gold', 'zone_performance', COUNT(DISTINCT from_nation) FROM trips
UNION ALL SELECT 'gold', 'weekday_profile', COUNT(DISTINCT isodow(started)) FROM trips""")
def medallion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "medallion")
    return run_medallion(spark, sales(spark, sf_dir), nations(spark, sf_dir), trip_spec("trips"), out)
