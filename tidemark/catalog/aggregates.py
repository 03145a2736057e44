"""Aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import EV, PLACED, SALES, events, mean, mean_ratio, query, total
from tidemark.catalog.scalars import NULLED, with_nulls
from tidemark.functions.amounts import mean as avg_money
from tidemark.functions.amounts import total as sum_money
from tidemark.operators import aggregates as A
from tidemark.plans.gold import with_places
from tidemark.tables import nations, sales, table


def rows():
    return F.count(F.lit(1)).alias("rows")


@query(f"""WITH {SALES} SELECT payment, vendor, COUNT(*) AS rows, {total('total')} AS revenue, {mean('fare')} AS avg_fare,
CAST(MIN(fare) AS DOUBLE) AS min_fare, CAST(MAX(fare) AS DOUBLE) AS max_fare FROM sales GROUP BY payment, vendor""")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summarise(
        sales(spark, sf_dir), ["payment", "vendor"],
        {
            "rows": F.count(F.lit(1)), "revenue": sum_money("total"), "avg_fare": avg_money("fare"),
            "min_fare": F.min("fare").cast("double"), "max_fare": F.max("fare").cast("double"),
        },
    )


@query("""SELECT CAST(ts AS DATE) AS day, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT hour(ts)) AS active_hours
FROM events GROUP BY 1""")
def distinct_users_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return A.distinct_counts(df, ["day"], {"users": F.col("user_id"), "active_hours": F.hour("ts")})


@query("""SELECT event_type, COUNT(DISTINCT strftime(ts, '%Y-%m-%d-%H')) AS day_hours FROM events GROUP BY 1""")
def distinct_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("-", F.to_date("ts").cast("string"), F.hour("ts").cast("string"))
    return A.distinct_counts(table(spark, sf_dir, "events"), ["event_type"], {"day_hours": key})


@query("SELECT event_type, TRUE AS within_bound FROM events GROUP BY event_type")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch must stay within 15 % of the exact count (it is built for 5 % standard error)."""
    df = table(spark, sf_dir, "events")
    exact = A.distinct_counts(df, ["event_type"], {"exact": F.col("user_id")})
    rough = A.distinct_counts(df, ["event_type"], {"rough": F.col("user_id")}, approx=True)
    near = F.abs(F.col("rough") - F.col("exact")) <= F.col("exact") * 0.15 + 1
    return exact.join(rough, "event_type").select("event_type", near.alias("within_bound"))


@query("""SELECT CAST(ts AS DATE) AS day, COUNT(*) AS rows, COUNT(*) FILTER (WHERE event_type = 'error') AS hits,
COUNT(*) FILTER (WHERE event_type = 'error') / COUNT(*) AS share FROM events GROUP BY 1""")
def conditional_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return A.share(df, ["day"], F.col("event_type") == "error")


@query(f"""WITH {SALES} SELECT payment, CAST(SUM(tip) AS DOUBLE) / CAST(SUM(fare) AS DOUBLE) AS ratio FROM sales GROUP BY payment""")
def ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ratio_of_sums(sales(spark, sf_dir), ["payment"], "tip", "fare")


@query(f"""SELECT l_returnflag, {mean_ratio('CASE WHEN l_discount <> 0 THEN l_tax / l_discount END')} AS ratio FROM lineitem GROUP BY l_returnflag""")
def mean_of_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.mean_of_ratios(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_tax", "l_discount")
    return out.withColumn("ratio", F.round("ratio", 9))


_ACTIVE = """SELECT CAST(hour(ts) AS INTEGER) AS hour, COUNT(*) AS rows, COUNT(DISTINCT CAST(ts AS DATE)) AS active_days,
{} AS per_day FROM events GROUP BY 1"""


@query(_ACTIVE.format("COUNT(*) / COUNT(DISTINCT CAST(ts AS DATE))"))
def per_active_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    return A.per_active_day(df, ["hour"], "ts")


@query(_ACTIVE.format("COUNT(*) // COUNT(DISTINCT CAST(ts AS DATE))"))
def per_active_day_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    return A.per_active_day(df, ["hour"], "ts", integer=True)


_FINE = f"""WITH {EV}, fine AS (SELECT CAST(ts AS DATE) AS day, event_type, SUM(value) AS s, COUNT(value) AS n, {mean('value')} AS m
FROM ev GROUP BY ALL)"""


@query(f"{_FINE} SELECT event_type, COUNT(*) AS groups, CAST(SUM(s) AS DOUBLE) / SUM(n) AS mean_value FROM fine GROUP BY event_type")
def two_level_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return A.two_level(df, ["day", "event_type"], ["event_type"], "value", weighted=True)


@query(f"{_FINE} SELECT event_type, COUNT(*) AS groups, {mean('CAST(m AS DECIMAL(24,8))')} AS mean_value FROM fine GROUP BY event_type")
def two_level_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return A.two_level(df, ["day", "event_type"], ["event_type"], "value", weighted=False)


@query("""SELECT event_type, q, round(CASE q WHEN 0.25 THEN quantile_cont(value, 0.25) WHEN 0.5 THEN quantile_cont(value, 0.5)
  ELSE quantile_cont(value, 0.95) END, 6) AS value
FROM events, (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.95)) p(q) GROUP BY event_type, q""")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.25, 0.5, 0.95])
    return out.withColumn("value", F.round("value", 6))


@query("""SELECT round(quantile_cont(l_extendedprice, 0.99), 6) AS value, CAST(0.99 AS DOUBLE) AS q FROM lineitem""")
def exact_quantile_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.quantiles(table(spark, sf_dir, "lineitem"), [], "l_extendedprice", [0.99])
    return out.withColumn("value", F.round("value", 6))


@query("SELECT event_type, TRUE AS within_bound FROM events GROUP BY event_type")
def approximate_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketched median must have rank within 1 % of the middle."""
    df = table(spark, sf_dir, "events").select("event_type", "value")
    mid = A.approx_quantiles(df, ["event_type"], "value", [0.5])
    ranked = df.join(mid.select("event_type", F.col("quantiles")[0].alias("mid")), "event_type")
    below = F.count_if(F.col("value") <= F.col("mid")) / F.count(F.lit(1))
    return ranked.groupBy("event_type").agg((F.abs(below - 0.5) <= 0.01).alias("within_bound"))


@query("""WITH c AS (SELECT s_nationkey AS nation, o_orderpriority AS most_common, COUNT(*) AS occurrences
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT nation, most_common, occurrences FROM (
  SELECT *, row_number() OVER (PARTITION BY nation ORDER BY occurrences DESC, most_common) AS rn FROM c) WHERE rn = 1""")
def most_common_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir).select(F.col("from_nation").alias("nation"), "payment")
    return A.most_common(df, ["nation"], "payment")


def daily_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day with errors, users and value."""
    return events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(
        rows(), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_distinct("user_id").alias("users"), F.sum("value").cast("double").alias("sum_value"),
    )


DAILY = f"""{EV}, daily AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS rows, COUNT(*) FILTER (WHERE event_type = 'error') AS errors,
  COUNT(DISTINCT user_id) AS users, CAST(SUM(value) AS DOUBLE) AS sum_value FROM ev GROUP BY 1)"""


@query(f"""WITH {DAILY} SELECT 'errors' AS x, 'rows' AS y, ROUND(corr(errors, rows), 8) AS correlation FROM daily
UNION ALL SELECT 'errors', 'sum_value', ROUND(corr(errors, sum_value), 8) FROM daily
UNION ALL SELECT 'users', 'rows', ROUND(corr(users, rows), 8) FROM daily
UNION ALL SELECT 'users', 'sum_value', ROUND(corr(users, sum_value), 8) FROM daily""")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.correlations(daily_figures(spark, sf_dir), ["errors", "users"], ["rows", "sum_value"])
    return out.withColumn("correlation", F.round("correlation", 8))


@query("""SELECT n_name, COUNT(*) FILTER (WHERE year(o_orderdate) = 1995) AS "1995", COUNT(*) FILTER (WHERE year(o_orderdate) = 1996) AS "1996",
COUNT(*) FILTER (WHERE year(o_orderdate) = 1997) AS "1997", COUNT(*) FILTER (WHERE year(o_orderdate) = 1998) AS "1998",
COUNT(*) FILTER (WHERE year(o_orderdate) NOT BETWEEN 1995 AND 1998 OR o_orderdate IS NULL) AS other
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def pivot_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = (
        table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_name", F.year("o_orderdate").alias("year"))
    )
    return A.pivot(df, ["n_name"], "year", [1995, 1996, 1997, 1998], F.count(F.lit(1)), other="other")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_places(sales(spark, sf_dir), nations(spark, sf_dir))


@query(f"""WITH {PLACED} SELECT from_r_name, from_n_name, CAST(GROUPING(from_r_name, from_n_name) AS INTEGER) AS level,
COUNT(*) AS rows, {total('total')} AS revenue FROM placed GROUP BY ROLLUP (from_r_name, from_n_name)""")
def rollup_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.rollup(placed(spark, sf_dir), ["from_r_name", "from_n_name"], {"rows": F.lit(1), "revenue": F.col("total")})
    return out.withColumn("revenue", F.round("revenue", 2).cast("double"))


_CUBE = f"""WITH {PLACED} SELECT from_r_name, payment, rate, CAST(GROUPING(from_r_name, payment, rate) AS INTEGER) AS level,
COUNT(*) AS rows, {total('total')} AS revenue FROM placed GROUP BY CUBE (from_r_name, payment, rate)"""


def _cubed(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = ["from_r_name", "payment", "rate"]
    out = A.cube(placed(spark, sf_dir), dims, {"rows": F.lit(1), "revenue": F.col("total")})
    return out.withColumn("revenue", F.round("revenue", 2).cast("double"))


@query(_CUBE)
def cube_three_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cubed(spark, sf_dir)


@query(f"""WITH {PLACED} SELECT from_r_name, rate, CAST(GROUPING(from_r_name, rate) AS INTEGER) AS level, COUNT(*) AS rows,
{mean('fare')} AS avg_fare, MIN(distance) AS least_distance, MAX(distance) AS most_distance FROM placed GROUP BY CUBE (from_r_name, rate)""")
def cube_with_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    fare, distance = F.col("fare"), F.col("distance")
    measures = {"rows": ("count", F.lit(1)), "avg_fare": ("mean", fare), "least_distance": ("min", distance), "most_distance": ("max", distance)}
    return A.cube(placed(spark, sf_dir), ["from_r_name", "rate"], measures)


@query(f"SELECT * FROM ({_CUBE}) WHERE level = 0 AND from_r_name = 'ASIA' AND rate IN ('A', 'R')")
def slice_and_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.slice_cube(_cubed(spark, sf_dir), {"level": 0, "from_r_name": "ASIA", "rate": ["A", "R"]})


@query("""WITH b AS (SELECT CAST(floor(l_extendedprice / 5000) * 5000 AS DOUBLE) AS bin, COUNT(*) AS rows FROM lineitem GROUP BY 1)
SELECT bin, rows, rows / SUM(rows) OVER () AS share FROM b""")
def histogram_of_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 5000)


@query(f"""WITH {SALES} SELECT from_nation, to_nation, COUNT(*) AS rows, {mean('fare')} AS avg_fare FROM sales
GROUP BY ALL HAVING COUNT(*) >= 20""")
def minimum_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.min_support(sales(spark, sf_dir), ["from_nation", "to_nation"], 20, {"avg_fare": avg_money("fare")})


@query(f"""WITH {NULLED} SELECT 'l_orderkey' AS column_name, COUNT(*) AS total, COUNT(l_orderkey) AS present, COUNT(*) - COUNT(l_orderkey) AS missing FROM nulled
UNION ALL SELECT 'l_quantity', COUNT(*), COUNT(l_quantity), COUNT(*) - COUNT(l_quantity) FROM nulled
UNION ALL SELECT 'l_returnflag', COUNT(*), COUNT(l_returnflag), COUNT(*) - COUNT(l_returnflag) FROM nulled
UNION ALL SELECT 'l_shipdate', COUNT(*), COUNT(l_shipdate), COUNT(*) - COUNT(l_shipdate) FROM nulled""")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.describe_nulls(with_nulls(spark, sf_dir).select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct(table(spark, sf_dir, "events"), ["user_id", "event_type"])
