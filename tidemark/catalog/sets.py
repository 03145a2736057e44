"""Sorting, top-k, unions, differences and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import query, total
from tidemark.catalog.scalars import three_sources
from tidemark.functions.amounts import exact
from tidemark.functions.amounts import total as sum_money
from tidemark.operators import calendar as C
from tidemark.operators import sets as S
from tidemark.tables import table


def rows():
    return F.count(F.lit(1)).alias("rows")


@query("""SELECT o_orderpriority, o_orderstatus, COUNT(*) AS rows FROM orders GROUP BY ALL ORDER BY rows DESC, o_orderpriority, o_orderstatus""")
def sort_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(rows())
    return S.sort(df, [F.col("rows").desc(), "o_orderpriority", "o_orderstatus"])


@query(f"""SELECT l_partkey, COUNT(*) AS rows, {total('CAST(l_extendedprice AS DECIMAL(12,2))')} AS revenue FROM lineitem
GROUP BY l_partkey ORDER BY revenue DESC, l_partkey LIMIT 25""")
def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        rows(), sum_money(exact("l_extendedprice")).alias("revenue")
    )
    return S.top_k(df, [F.col("revenue").desc(), "l_partkey"], 25)


@query("""SELECT kind, COUNT(*) AS rows FROM (SELECT o_orderstatus AS kind FROM orders UNION ALL SELECT l_returnflag FROM lineitem
UNION ALL SELECT event_type FROM events) GROUP BY kind""")
def union_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [
        table(spark, sf_dir, "orders").select("o_orderstatus"),
        table(spark, sf_dir, "lineitem").select("l_returnflag"),
        table(spark, sf_dir, "events").select("event_type"),
    ]
    return S.stack(frames).toDF("kind").groupBy("kind").agg(rows())


@query("""SELECT 'orders' AS source, COUNT(*) AS rows, COUNT(o_totalprice) AS with_amount, MIN(o_orderdate) AS first_at FROM orders
UNION ALL SELECT 'lines', COUNT(*), COUNT(l_extendedprice), MIN(l_shipdate) FROM lineitem
UNION ALL SELECT 'events', COUNT(*), 0, MIN(ts) FROM events""")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return three_sources(spark, sf_dir).groupBy("source").agg(
        rows(), F.count("amount").alias("with_amount"), F.min("at").alias("first_at")
    )


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.key_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


_ORDER_SPAN = "SELECT CAST(MIN(o_orderdate) AS DATE) AS a, CAST(MAX(o_orderdate) AS DATE) AS b FROM orders"


@query(f"SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM ({_ORDER_SPAN})")
def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.date_spine(C.span_of(table(spark, sf_dir, "orders"), "o_orderdate"))


@query(f"""SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date, CAST(year(d) AS INTEGER) AS year,
CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name,
CAST(weekofyear(d) AS INTEGER) AS week, CAST(day(d) AS INTEGER) AS day_of_month, CAST(isodow(d) AS INTEGER) AS day_of_week,
dayname(d) AS day_name, isodow(d) >= 6 AS is_weekend
FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM ({_ORDER_SPAN}))""")
def date_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.date_dim(C.date_spine(C.span_of(table(spark, sf_dir, "orders"), "o_orderdate")))


def gappy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without March 1999 and without the 13th of any month."""
    d = F.col("o_orderdate")
    gone = ((F.year(d) == 1999) & (F.month(d) == 3)) | (F.dayofmonth(d) == 13)
    return table(spark, sf_dir, "orders").filter(~gone)


_GAPPY = """gappy AS (SELECT * FROM orders WHERE NOT ((year(o_orderdate) = 1999 AND month(o_orderdate) = 3) OR day(o_orderdate) = 13)),
span AS (SELECT CAST(MIN(o_orderdate) AS DATE) AS a, CAST(MAX(o_orderdate) AS DATE) AS b FROM gappy)"""


@query(f"""WITH {_GAPPY} SELECT d AS day FROM (SELECT CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE) AS d FROM span)
WHERE d NOT IN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) FROM gappy)""")
def missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.find_gaps(gappy_orders(spark, sf_dir), "o_orderdate", "month")


@query(f"""WITH {_GAPPY} SELECT d AS day FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM span)
WHERE d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM gappy)""")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.find_gaps(gappy_orders(spark, sf_dir), "o_orderdate", "day")


@query(f"""WITH {_GAPPY}, n AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS rows FROM gappy GROUP BY 1)
SELECT d AS day, COALESCE(rows, 0) AS rows FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM span)
LEFT JOIN n ON d = n.day""")
def zero_filled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_day = gappy_orders(spark, sf_dir).groupBy(F.to_date("o_orderdate").alias("day")).agg(rows())
    return C.fill_gaps(per_day, "day", "day", ["rows"])
