"""Window functions, over aggregated frames and over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.aggregates import DAILY, daily_figures, placed
from tidemark.catalog.base import PLACED, events, mean_over, query, total
from tidemark.functions.amounts import exact
from tidemark.functions.amounts import total as sum_money
from tidemark.operators import windows as W
from tidemark.operators.ranges import lay_out, running
from tidemark.tables import table


def rows():
    return F.count(F.lit(1)).alias("rows")


@query(f"""WITH {PLACED}, d AS (SELECT from_r_name, CAST(started AS DATE) AS day, SUM(total) AS rev FROM placed GROUP BY ALL)
SELECT from_r_name, day, CAST(ROUND(rev, 2) AS DOUBLE) AS revenue,
CAST(ROUND(SUM(rev) OVER (PARTITION BY from_r_name ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS DOUBLE) AS running_total FROM d""")
def running_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = placed(spark, sf_dir).groupBy("from_r_name", F.to_date("started").alias("day")).agg(F.sum("total").alias("rev"))
    out = W.running_total(d, ["from_r_name"], ["day"], "rev")
    return out.select(
        "from_r_name", "day", F.round("rev", 2).cast("double").alias("revenue"),
        F.round("running_total", 2).cast("double").alias("running_total"),
    )


@query("""SELECT event_id, user_id, CAST(SUM(CAST(value AS DECIMAL(12,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent
FROM events""")
def running_total_of_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level running total per user, spread over ranges."""
    df = events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    order = ["ts", "event_id"]
    out = running(lay_out(df, ["user_id"], order), ["user_id"], order, {"spent": ("sum", F.col("value"))})
    return out.select("event_id", "user_id", F.col("spent").cast("double").alias("spent"))


_NATION_ROWS = f"""{PLACED}, n AS (SELECT from_r_name, from_n_name, COUNT(*) AS trips FROM placed GROUP BY ALL)"""


def nation_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).groupBy("from_r_name", "from_n_name").agg(F.count(F.lit(1)).alias("trips"))


@query(f"""WITH {_NATION_ROWS} SELECT from_r_name, from_n_name, trips,
CAST(rank() OVER (PARTITION BY from_r_name ORDER BY trips DESC) AS INTEGER) AS rank_gaps,
CAST(dense_rank() OVER (PARTITION BY from_r_name ORDER BY trips DESC) AS INTEGER) AS rank_dense,
CAST(row_number() OVER (PARTITION BY from_r_name ORDER BY trips DESC, from_n_name) AS INTEGER) AS row_num FROM n""")
def three_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rank_all(nation_trips(spark, sf_dir), ["from_r_name"], [F.col("trips").desc()], ["from_n_name"])


@query(f"""WITH {_NATION_ROWS} SELECT * FROM (SELECT from_r_name, from_n_name, trips,
CAST(row_number() OVER (PARTITION BY from_r_name ORDER BY trips DESC, from_n_name) AS INTEGER) AS place FROM n) WHERE place <= 2""")
def top_two_per_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("trips").desc(), "from_n_name"]
    return W.top_n_per(nation_trips(spark, sf_dir), ["from_r_name"], order, 2, ties=False)


_HOURS = "h AS (SELECT event_type, CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, CAST(hour(ts) AS INTEGER) AS hour, COUNT(*) AS trips FROM events GROUP BY ALL)"


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    day_type = F.when(F.weekday("ts") >= 5, "weekend").otherwise("weekday")
    return table(spark, sf_dir, "events").groupBy("event_type", day_type.alias("day_type"), F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("trips")
    )


@query(f"""WITH {_HOURS} SELECT event_type, day_type, hour, trips FROM (SELECT *, row_number() OVER
(PARTITION BY event_type, day_type ORDER BY trips DESC, hour) AS rn FROM h) WHERE rn = 1""")
def peak_hour_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.arg_max_per(event_hours(spark, sf_dir), ["event_type", "day_type"], "trips", "hour")


@query(f"""WITH {_HOURS}, t AS (SELECT event_type, hour, CAST(SUM(trips) AS BIGINT) AS trips FROM h GROUP BY ALL)
SELECT event_type, first(hour ORDER BY trips DESC, hour) AS peak_hour, MAX(trips) AS peak_trips,
first(hour ORDER BY trips, hour) AS quiet_hour, MIN(trips) AS quiet_trips FROM t GROUP BY event_type""")
def busiest_and_quietest_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_hour = event_hours(spark, sf_dir).groupBy("event_type", "hour").agg(F.sum("trips").alias("trips"))
    return W.extremes(per_hour, ["event_type"], "trips", "hour")


@query(f"""WITH {DAILY} SELECT day, rows, {mean_over('rows', 'ORDER BY day ROWS 6 PRECEDING')} AS avg_7,
{mean_over('rows', 'ORDER BY day ROWS 29 PRECEDING')} AS avg_30 FROM daily""")
def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = daily_figures(spark, sf_dir).select("day", "rows")
    return W.moving_avg(W.moving_avg(df, [], ["day"], "rows", 7, "avg_7"), [], ["day"], "rows", 30, "avg_30")


@query(f"""WITH {PLACED}, d AS (SELECT from_n_name, CAST(started AS DATE) AS day, COUNT(*) AS trips FROM placed GROUP BY ALL)
SELECT from_n_name, day, trips, {mean_over('trips', 'PARTITION BY from_n_name ORDER BY day ROWS 6 PRECEDING')} AS avg_7 FROM d""")
def moving_average_per_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = placed(spark, sf_dir).groupBy("from_n_name", F.to_date("started").alias("day")).agg(F.count(F.lit(1)).alias("trips"))
    return W.moving_avg(d, ["from_n_name"], ["day"], "trips", 7, "avg_7")


@query(f"""WITH {PLACED}, m AS (SELECT from_r_name, CAST(date_trunc('month', started) AS DATE) AS month, COUNT(*) AS trips FROM placed GROUP BY ALL),
p AS (SELECT *, lag(trips) OVER w AS prev_value, lead(trips) OVER w AS next_value FROM m WINDOW w AS (PARTITION BY from_r_name ORDER BY month))
SELECT from_r_name, month, trips, prev_value, next_value, CASE WHEN prev_value <> 0 THEN CAST(trips - prev_value AS DOUBLE) / prev_value * 100 END AS growth_pct FROM p""")
def month_over_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = placed(spark, sf_dir).groupBy("from_r_name", F.trunc(F.to_date("started"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("trips")
    )
    return W.growth(m, ["from_r_name"], ["month"], "trips")


@query(f"""WITH {DAILY}, p AS (SELECT day, rows, lag(rows, 7) OVER (ORDER BY day) AS prev_value, lead(rows) OVER (ORDER BY day) AS next_value FROM daily)
SELECT *, CASE WHEN prev_value <> 0 THEN CAST(rows - prev_value AS DOUBLE) / prev_value * 100 END AS growth_pct FROM p""")
def week_over_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.growth(daily_figures(spark, sf_dir).select("day", "rows"), [], ["day"], "rows", 7)


@query(f"""WITH {_NATION_ROWS} SELECT from_r_name, from_n_name, trips,
CAST(trips AS DOUBLE) / CAST(SUM(trips) OVER (PARTITION BY from_r_name) AS DOUBLE) * 100 AS pct_of_group,
CAST(trips AS DOUBLE) / CAST(SUM(trips) OVER () AS DOUBLE) * 100 AS pct_of_all,
CAST(SUM(trips) OVER (PARTITION BY from_r_name ORDER BY trips DESC, from_n_name ROWS UNBOUNDED PRECEDING) AS DOUBLE)
  / CAST(SUM(trips) OVER (PARTITION BY from_r_name) AS DOUBLE) * 100 AS cumulative_pct FROM n""")
def percent_of_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.percent_of(nation_trips(spark, sf_dir), ["from_r_name"], "trips", "from_n_name")


@query(f"""WITH s AS (SELECT l_suppkey, COUNT(*) AS trips, SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS rev FROM lineitem GROUP BY 1),
t AS (SELECT *, ntile(4) OVER (ORDER BY trips, l_suppkey) AS q FROM s)
SELECT CAST(q AS INTEGER) AS segment, COUNT(*) AS suppliers, MIN(trips) AS min_trips, MAX(trips) AS max_trips, {total('rev')} AS revenue
FROM t GROUP BY q""")
def supplier_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("trips"), F.sum(exact("l_extendedprice")).alias("rev")
    )
    return W.quantile_segments(per, ["trips", "l_suppkey"], 4).groupBy("segment").agg(
        F.count(F.lit(1)).alias("suppliers"), F.min("trips").alias("min_trips"), F.max("trips").alias("max_trips"),
        sum_money("rev").alias("revenue"),
    )


@query(f"WITH {_NATION_ROWS} SELECT from_n_name, from_r_name, trips, percent_rank() OVER (ORDER BY trips) AS pct_rank FROM n")
def percent_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.percentile_rank(nation_trips(spark, sf_dir), [], "trips")


@query(f"""WITH {PLACED} SELECT from_n_name, {total('total')} AS revenue,
CAST(rank() OVER (ORDER BY ROUND(SUM(total), 2) DESC) AS INTEGER) AS place FROM placed GROUP BY from_n_name""")
def rank_of_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.agg_rank(placed(spark, sf_dir), ["from_n_name"], sum_money("total"), "revenue")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def sequence_within_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return W.sequence_no(df, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "seq")


_BANDS = """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS trips FROM orders GROUP BY 1),
w AS (SELECT month, trips, lag(trips) OVER (ORDER BY month) AS prev_value, COUNT(*) OVER f AS n,
  CAST(SUM(trips) OVER f AS DOUBLE) / NULLIF(COUNT(*) OVER f, 0) AS m0, stddev_samp(trips) OVER f AS s0
  FROM m WINDOW f AS (ORDER BY month ROWS BETWEEN {frame})),
b AS (SELECT month, trips, prev_value, CASE WHEN n >= 2 THEN m0 END AS mu, CASE WHEN n >= 2 THEN s0 END AS sd,
  CASE WHEN prev_value <> 0 THEN abs(trips - prev_value) / prev_value * 100 END AS change_pct FROM w),
c AS (SELECT *, mu + 2.0 * sd AS hi, CASE WHEN mu IS NOT NULL THEN greatest(mu - 2.0 * sd, 0.0) END AS lo FROM b)
SELECT month, trips, prev_value, round(mu, 6) AS band_mean, round(sd, 6) AS band_std, round(change_pct, 6) AS change_pct,
round(hi, 6) AS band_upper, round(lo, 6) AS band_lower, COALESCE(trips > hi OR trips < lo, FALSE) AS outside_band,
COALESCE(change_pct > 50, FALSE) AS jump, COALESCE(trips > hi OR trips < lo, FALSE) OR COALESCE(change_pct > 50, FALSE) AS is_anomaly FROM c"""


def _banded(spark: SparkSession, sf_dir: str, include_current: bool) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("trips")
    )
    out = W.volume_bands(m, "month", "trips", include_current=include_current)
    return out.withColumns({c: F.round(c, 6) for c in ("band_mean", "band_std", "change_pct", "band_upper", "band_lower")})


@query(_BANDS.format(frame="3 PRECEDING AND 1 PRECEDING"))
def volume_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _banded(spark, sf_dir, False)


@query(_BANDS.format(frame="2 PRECEDING AND CURRENT ROW"))
def volume_bands_with_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _banded(spark, sf_dir, True)


@query(f"""WITH {DAILY}, s AS (SELECT AVG(rows) AS mu, stddev_samp(rows) AS sd FROM daily)
SELECT day, rows, round(mu, 6) AS overall_mean, round(sd, 6) AS overall_std FROM daily, s WHERE abs(rows - mu) > 1.5 * sd""")
def outlier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.outlier_periods(daily_figures(spark, sf_dir).select("day", "rows"), "rows", 1.5)
    return out.withColumns({c: F.round(c, 6) for c in ("overall_mean", "overall_std")})
