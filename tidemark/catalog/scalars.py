"""Projections, filters and row-level functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import EV, NATIONS, SALES, events, hash_key, mean, query, total
from tidemark.functions import scalars as S
from tidemark.functions import times as T
from tidemark.functions import udfs as U
from tidemark.functions.amounts import exact
from tidemark.functions.amounts import mean as avg_money
from tidemark.functions.amounts import total as sum_money
from tidemark.operators.projections import harmonise, impute_median, keep, stage
from tidemark.operators.sets import stack_by_name
from tidemark.tables import nations, sales, table


def rows():
    return F.count(F.lit(1)).alias("rows")


@query("""SELECT o_orderkey AS order_id, CAST(o_custkey AS INTEGER) AS customer_id, o_totalprice AS amount,
CAST(o_orderdate AS DATE) AS order_date FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL""")
def stage_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "order_id": ("o_orderkey", "bigint"),
        "customer_id": ("o_custkey", "int"),
        "amount": ("o_totalprice", "double"),
        "order_date": ("o_orderdate", "date"),
    }
    return stage(table(spark, sf_dir, "orders"), columns, ["customer_id", "order_date"])


def three_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, order lines and events in one layout."""
    orders = harmonise(
        table(spark, sf_dir, "orders"),
        {"at": "o_orderdate", "who": "o_custkey", "amount": exact("o_totalprice"), "kind": "o_orderstatus"},
        "orders",
    )
    lines = harmonise(
        table(spark, sf_dir, "lineitem"),
        {"at": "l_shipdate", "who": "l_suppkey", "amount": exact("l_extendedprice"), "kind": "l_returnflag"},
        "lines",
    )
    acts = harmonise(events(spark, sf_dir), {"at": "ts", "who": "user_id", "kind": "event_type"}, "events")
    return stack_by_name([orders, lines, acts])


@query(f"""WITH everything AS (
  SELECT 'orders' AS source, o_orderstatus AS kind, o_custkey AS who, CAST(o_totalprice AS DECIMAL(12,2)) AS amount FROM orders
  UNION ALL SELECT 'lines', l_returnflag, l_suppkey, CAST(l_extendedprice AS DECIMAL(12,2)) FROM lineitem
  UNION ALL SELECT 'events', event_type, user_id, NULL FROM events)
SELECT source, kind, COUNT(*) AS rows, COUNT(DISTINCT who) AS actors, {total('amount')} AS amount
FROM everything GROUP BY source, kind""")
def harmonise_three_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return three_sources(spark, sf_dir).groupBy("source", "kind").agg(
        rows(), F.count_distinct("who").alias("actors"), sum_money("amount").alias("amount")
    )


@query(f"""WITH {SALES} SELECT payment, COUNT(*) AS rows, {total('total')} AS revenue FROM sales
WHERE fare BETWEEN 5000 AND 60000 AND (payment IN ('1-URGENT', '2-HIGH') OR rate <> 'A')
  AND NOT (from_nation = to_nation) AND ended IS NOT NULL GROUP BY payment""")
def filter_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = (
        F.col("fare").between(5000, 60000)
        & (F.col("payment").isin("1-URGENT", "2-HIGH") | (F.col("rate") != "A"))
        & ~(F.col("from_nation") == F.col("to_nation"))
        & F.col("ended").isNotNull()
    )
    return keep(sales(spark, sf_dir), wanted).groupBy("payment").agg(rows(), sum_money("total").alias("revenue"))


# Quantity steps and their order.
STEPS = ((5, "0-5"), (10, "5-10"), (20, "10-20"), (40, "20-40"))
STEP_ORDER = ("0-5", "5-10", "10-20", "20-40", "40+")
_STEP_SQL = """CASE WHEN l_quantity < 5 THEN '0-5' WHEN l_quantity < 10 THEN '5-10' WHEN l_quantity < 20 THEN '10-20'
  WHEN l_quantity < 40 THEN '20-40' ELSE '40+' END"""


@query(f"""SELECT {_STEP_SQL} AS step, COUNT(*) AS rows,
{mean('CAST(l_extendedprice AS DECIMAL(12,2))')} AS avg_fare FROM lineitem GROUP BY 1""")
def bucket_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(S.steps("l_quantity", STEPS, "40+").alias("step")).agg(
        rows(), avg_money(exact("l_extendedprice")).alias("avg_fare")
    )


@query(f"""SELECT step, rows, CAST(row_number() OVER (ORDER BY CASE step WHEN '0-5' THEN 1 WHEN '5-10' THEN 2
WHEN '10-20' THEN 3 WHEN '20-40' THEN 4 ELSE 5 END) AS INTEGER) AS place
FROM (SELECT {_STEP_SQL} AS step, COUNT(*) AS rows FROM lineitem GROUP BY 1)""")
def order_buckets_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").groupBy(S.steps("l_quantity", STEPS, "40+").alias("step")).agg(rows())
    return S.order_by_rank(df.withColumn("place", S.rank_of("step", STEP_ORDER)), "step", STEP_ORDER)


@query(f"""WITH {SALES} SELECT rate, COUNT(*) AS rows,
CAST(MIN((epoch(ended) - epoch(started)) / 60) AS DOUBLE) AS min_minutes,
CAST(MAX((epoch(ended) - epoch(started)) / 60) AS DOUBLE) AS max_minutes,
COUNT(*) FILTER (WHERE ended < started) AS backwards FROM sales GROUP BY rate""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir).withColumn("minutes", T.minutes_between("started", "ended"))
    return df.groupBy("rate").agg(
        rows(), F.min("minutes").alias("min_minutes"), F.max("minutes").alias("max_minutes"),
        F.count_if(F.col("minutes") < 0).alias("backwards"),
    )


@query("""SELECT l_returnflag, COUNT(*) AS rows,
COUNT(*) FILTER (WHERE l_discount = 0) AS undefined,
MAX(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END) AS max_ratio,
MIN(CASE WHEN l_discount <> 0 THEN l_tax / l_discount ELSE -1 END) AS min_with_default
FROM lineitem GROUP BY l_returnflag""")
def guarded_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.safe_divide("l_tax", "l_discount")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        rows(),
        F.count_if(r.isNull()).alias("undefined"),
        F.max(r).alias("max_ratio"),
        F.min(S.safe_divide("l_tax", "l_discount", -1.0)).alias("min_with_default"),
    )


@query("""SELECT CAST(ts AS DATE) AS at_date, CAST(hour(ts) AS INTEGER) AS at_hour, CAST(isodow(ts) AS INTEGER) AS at_dow,
dayname(ts) AS at_day_name, CAST(weekofyear(ts) AS INTEGER) AS at_week, CAST(month(ts) AS INTEGER) AS at_month,
monthname(ts) AS at_month_name, CAST(quarter(ts) AS INTEGER) AS at_quarter, CAST(year(ts) AS INTEGER) AS at_year,
CAST(year(ts) * 100 + month(ts) AS INTEGER) AS at_month_key, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS at_date_key,
COUNT(*) AS rows FROM events GROUP BY ALL""")
def date_parts_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.date_parts(table(spark, sf_dir, "events").select("ts"), "ts", "at_")
    return parts.groupBy(*[c for c in parts.columns if c != "ts"]).agg(rows())


@query("""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS rows FROM orders GROUP BY 1""")
def truncate_to_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(T.month_of("o_orderdate").alias("month")).agg(rows())


_LATER = "ts + to_seconds(CAST(round(value * 60) AS BIGINT))"


def ended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events lasting ``value`` minutes."""
    seconds = F.round(F.col("value") * 60).cast("int")
    return table(spark, sf_dir, "events").withColumn(
        "ended", F.col("ts") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    )


@query(f"""SELECT event_type, COUNT(*) AS rows, CAST(SUM(date_diff('minute', ts, {_LATER})) AS BIGINT) AS boundaries,
CAST(SUM(CAST(floor((epoch({_LATER}) - epoch(ts)) / 60) AS BIGINT)) AS BIGINT) AS full_minutes
FROM events GROUP BY event_type""")
def minute_boundary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ended_events(spark, sf_dir)
    whole = F.floor(T.minutes_between("ts", "ended")).cast("bigint")
    return df.groupBy("event_type").agg(
        rows(), F.sum(T.minute_boundaries("ts", "ended")).alias("boundaries"), F.sum(whole).alias("full_minutes")
    )


@query("""SELECT CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type,
isodow(ts) < 6 AND (hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19) AS is_rush,
isodow(ts) < 6 AND (hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 16 AND 19) AS is_long_rush,
CASE WHEN isodow(ts) < 6 AND hour(ts) BETWEEN 7 AND 9 THEN 'morning_rush'
  WHEN isodow(ts) < 6 AND hour(ts) BETWEEN 17 AND 19 THEN 'evening_rush' ELSE 'non_rush' END AS rush,
COUNT(*) AS rows FROM events GROUP BY ALL""")
def day_and_rush_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(
        T.day_type("ts").alias("day_type"),
        T.is_rush_hour("ts").alias("is_rush"),
        T.is_rush_hour("ts", ((7, 9), (16, 19))).alias("is_long_rush"),
        T.rush_category("ts").alias("rush"),
    ).agg(rows())


# The nations that play the part of hubs.
HUBS = (1, 7, 13)


@query(f"""WITH {SALES} SELECT (from_nation IN (1, 7, 13) OR to_nation IN (1, 7, 13)) AS is_hub,
CASE WHEN from_nation IN (1, 7, 13) THEN 'From' WHEN to_nation IN (1, 7, 13) THEN 'To' END AS way, COUNT(*) AS rows
FROM sales GROUP BY ALL""")
def hub_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = ("from_nation", "to_nation")
    return sales(spark, sf_dir).groupBy(
        S.touches(ends, HUBS).alias("is_hub"), S.direction(*ends, HUBS).alias("way")
    ).agg(rows())


@query(f"""WITH {SALES} SELECT (ended < started OR fare > 90000 OR (distance < 2 AND fare > 10000)) AS suspicious,
COUNT(*) AS rows FROM sales GROUP BY 1""")
def suspicious_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = S.any_of(
        [F.col("ended") < F.col("started"), F.col("fare") > 90000, (F.col("distance") < 2) & (F.col("fare") > 10000)]
    )
    return sales(spark, sf_dir).groupBy(flag.alias("suspicious")).agg(rows())


def with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with some quantities and flags missing."""
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "l_quantity": F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity")),
            "l_returnflag": F.when(F.col("l_partkey") % 5 != 0, F.col("l_returnflag")),
        }
    )


NULLED = """nulled AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate,
  CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity END AS l_quantity,
  CASE WHEN l_partkey % 5 <> 0 THEN l_returnflag END AS l_returnflag FROM lineitem)"""


@query(f"""WITH {NULLED} SELECT COALESCE(l_returnflag, '?') AS l_returnflag, COUNT(*) AS rows,
SUM(COALESCE(l_quantity, 1)) AS sum_quantity FROM nulled GROUP BY 1""")
def fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = S.fill(with_nulls(spark, sf_dir), {"l_quantity": 1, "l_returnflag": "?"})
    return filled.groupBy("l_returnflag").agg(rows(), F.sum("l_quantity").alias("sum_quantity"))


@query("""WITH holes AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS c_acctbal FROM customer)
SELECT c_custkey, COALESCE(c_acctbal, (SELECT median(c_acctbal) FROM holes)) AS c_acctbal FROM holes""")
def impute_with_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal")).alias("c_acctbal")
    )
    return impute_median(holes, "c_acctbal")


@query(f"""WITH {NULLED} SELECT CASE WHEN l_returnflag IS NULL OR l_returnflag = 'R' THEN 1
  WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS code, COUNT(*) AS rows FROM nulled GROUP BY 1""")
def recode_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = S.bucket([(F.col("l_returnflag") == "A", 1), (F.col("l_returnflag") == "N", 2), (F.col("l_returnflag") == "R", 99)], None)
    df = with_nulls(spark, sf_dir).withColumn("raw", raw.cast("int"))
    return df.groupBy(S.recode("raw", [99], 1).alias("code")).agg(rows())


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal > 9000 THEN 9000.0 ELSE c_acctbal END AS c_acctbal
FROM customer""")
def clamp_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.clamp("c_acctbal", 0.0, 9000.0).alias("c_acctbal"))


# Date formats tried in turn.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM-dd-yyyy", "yyyy-MM-dd'T'HH:mm:ss")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def parse_mixed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("o_orderkey") % 5
    text = F
    for i, f in enumerate(DATE_FORMATS):
        text = text.when(turn == i, F.date_format("o_orderdate", f))
    df = table(spark, sf_dir, "orders").select("o_orderkey", text.otherwise("soon").alias("text"))
    return df.select("o_orderkey", S.parse_any("text", DATE_FORMATS).cast("date").alias("parsed"))


# Accepted spellings.
SEGMENTS = {"building": "construction", "machinery": "industry", "household": "consumer", "furniture": "consumer"}


@query("""SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'construction' WHEN c_mktsegment = 'MACHINERY' THEN 'industry'
WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'consumer' ELSE 'unknown' END AS segment, COUNT(*) AS rows
FROM customer GROUP BY 1""")
def normalise_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, c = F.col("c_custkey") % 3, F.col("c_mktsegment")
    messy = F.when(turn == 0, F.lower(c)).when(turn == 1, F.concat(F.lit("  "), c)).otherwise(F.initcap(c))
    df = table(spark, sf_dir, "customer").select(messy.alias("messy"))
    return df.groupBy(S.normalise("messy", SEGMENTS, "unknown").alias("segment")).agg(rows())


@query(f"""WITH {NULLED} SELECT {hash_key('l_orderkey', 'l_linenumber', 'l_returnflag')} AS fact_key, 'line-' || l_orderkey || '-' || l_linenumber AS readable_key, COUNT(*) AS rows
FROM nulled GROUP BY ALL""")
def hashed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_nulls(spark, sf_dir).groupBy(
        S.hash_key(["l_orderkey", "l_linenumber", "l_returnflag"]).alias("fact_key"),
        S.tagged_key("line", "l_orderkey", "l_linenumber").alias("readable_key"),
    ).agg(rows())


@query("""SELECT lang, COUNT(*) AS rows, COUNT(*) FILTER (WHERE regexp_full_match(lang, '[a-z]{2}')) AS two_letters,
COUNT(*) FILTER (WHERE regexp_matches(source, '^(?:[a-m])')) AS early_source FROM documents GROUP BY lang""")
def regex_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        rows(),
        F.count_if(S.matches("lang", "[a-z]{2}")).alias("two_letters"),
        F.count_if(S.matches("source", "[a-m]", full=False)).alias("early_source"),
    )


@query(f"""WITH {NATIONS}, {SALES} SELECT CASE WHEN distance <= 1 THEN 'short' WHEN distance <= 5 THEN 'medium' WHEN distance <= 15 THEN 'long'
  ELSE 'very_long' END AS distance_class,
CASE WHEN r_name IN ('AFRICA', 'MIDDLE EAST') THEN 'Outer' ELSE 'Core' END AS region_group, COUNT(*) AS rows
FROM sales JOIN nations ON from_nation = n_nationkey GROUP BY ALL""")
def classify_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir).join(nations(spark, sf_dir), F.col("from_nation") == F.col("n_nationkey"))
    return df.groupBy(
        U.distance_class("distance").alias("distance_class"), U.region_of("r_name").alias("region_group")
    ).agg(rows())


_DAY_SQL = """CASE WHEN hour(ts) BETWEEN 6 AND 9 THEN 'morning_rush' WHEN hour(ts) BETWEEN 10 AND 15 THEN 'midday'
WHEN hour(ts) BETWEEN 16 AND 19 THEN 'evening_rush' WHEN hour(ts) >= 20 THEN 'evening' ELSE 'overnight' END"""


@query(f"""SELECT {_DAY_SQL} AS time_of_day,
CASE WHEN hour(ts) <= 3 THEN 'late_night' WHEN hour(ts) <= 6 THEN 'early_morning' WHEN hour(ts) <= 9 THEN 'morning_rush'
  WHEN hour(ts) <= 15 THEN 'midday' WHEN hour(ts) <= 19 THEN 'evening_rush' ELSE 'evening' END AS day_part,
CASE WHEN value < 10 THEN 'cheap' WHEN value <= 30 THEN 'moderate' WHEN value <= 75 THEN 'expensive' ELSE 'premium' END AS fare_class,
COUNT(*) AS rows FROM events GROUP BY ALL""")
def classify_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(
        U.time_of_day(F.hour("ts")).alias("time_of_day"),
        U.day_part(F.hour("ts")).alias("day_part"),
        U.fare_class("value").alias("fare_class"),
    ).agg(rows())


_PCT = "CASE WHEN l_discount <> 0 THEN l_tax / l_discount * 100.0 END"


@query(f"""SELECT l_returnflag, COUNT(*) AS rows, MAX({_PCT}) AS max_pct, COUNT({_PCT}) AS defined, CAST(0 AS BIGINT) AS disagreements
FROM lineitem GROUP BY l_returnflag""")
def vectorised_tip_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Arrow function and its built-in twin must agree on every row."""
    df = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", U.tip_pct_vec("l_tax", "l_discount").alias("vec"), U.tip_pct("l_tax", "l_discount").alias("twin")
    )
    return df.groupBy("l_returnflag").agg(
        rows(), F.max("vec").alias("max_pct"), F.count("vec").alias("defined"),
        F.count_if(~F.col("vec").eqNullSafe(F.col("twin"))).alias("disagreements"),
    )


@query(f"""WITH {EV} SELECT {_DAY_SQL} AS part, CASE WHEN value <= 1 THEN 'short' WHEN value <= 5 THEN 'medium'
WHEN value <= 15 THEN 'long' ELSE 'very_long' END AS size, COUNT(*) AS rows FROM ev GROUP BY ALL""")
def functions_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    U.register_functions(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("v_events")
    return spark.sql(
        "SELECT time_of_day(hour(ts)) AS part, distance_class(value) AS size, count(*) AS rows FROM v_events GROUP BY ALL"
    )


@query(f"""WITH {SALES} SELECT payment, CAST(ROUND(SUM(total), 1) AS DOUBLE) AS revenue_1, CAST(ROUND(SUM(total), 0) AS DOUBLE) AS revenue_0
FROM sales GROUP BY payment""")
def rounded_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy("payment").agg(
        sum_money("total", 1).alias("revenue_1"), sum_money("total", 0).alias("revenue_0")
    )
