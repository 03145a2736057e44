"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import EV, NATIONS, PLACED, SALES, events, mean, query, total
from tidemark.functions.amounts import exact
from tidemark.functions.amounts import mean as avg_money
from tidemark.functions.amounts import total as sum_money
from tidemark.operators import joins as J
from tidemark.operators.history import open_dimension, scd2_apply
from tidemark.operators.windows import top_n_per
from tidemark.tables import nations, sales, table


def rows():
    return F.count(F.lit(1)).alias("rows")


def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = F.col("from_nation") == F.col("n_nationkey")
    aggs = [rows(), sum_money("total").alias("revenue"), avg_money("fare").alias("avg_fare")]
    return J.join_agg(sales(spark, sf_dir), J.small(nations(spark, sf_dir)), on, ["r_name", "n_name"], aggs)


_NATION_REVENUE = f"""{SALES}, {NATIONS}, revenue AS (
  SELECT r_name, n_name, COUNT(*) AS rows, {total('total')} AS revenue, {mean('fare')} AS avg_fare
  FROM sales JOIN nations ON from_nation = n_nationkey GROUP BY r_name, n_name)"""


@query(f"""WITH {_NATION_REVENUE} SELECT * FROM (SELECT r_name, n_name, rows, revenue, avg_fare,
CAST(rank() OVER (PARTITION BY r_name ORDER BY revenue DESC) AS INTEGER) AS place FROM revenue) WHERE place <= 3""")
def top_nations_by_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: best three nations of each region."""
    return top_n_per(nation_revenue(spark, sf_dir), ["r_name"], [F.col("revenue").desc()], 3)


@query(f"WITH {_NATION_REVENUE} SELECT * FROM revenue")
def join_and_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_revenue(spark, sf_dir)


@query("""SELECT lang, COALESCE(CAST(quality AS INTEGER), -1) AS quality, COUNT(*) AS rows
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")
def lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    found = J.lookup(docs, table(spark, sf_dir, "labels"), ["doc_id"], {"quality": -1, "toxic": -1})
    return found.groupBy("lang", "quality").agg(rows())


@query(f"WITH {PLACED} SELECT from_r_name, to_r_name, COUNT(*) AS rows, {total('total')} AS revenue FROM placed GROUP BY ALL")
def role_playing_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = {"from": "from_nation", "to": "to_nation"}
    df = J.enrich_roles(sales(spark, sf_dir), nations(spark, sf_dir), "n_nationkey", roles)
    return df.groupBy("from_r_name", "to_r_name").agg(rows(), sum_money("total").alias("revenue"))


@query("""SELECT c_mktsegment, p_type, n_name, COUNT(*) AS rows, SUM(l_quantity) AS sum_quantity
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def star_join_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer hangs on orders and nation on supplier: those meet first, so lines meet three tables, not five."""
    t = lambda n: table(spark, sf_dir, n)
    fact = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    orders = J.star_join(t("orders").select("o_orderkey", "o_custkey"), [(t("customer").select("c_custkey", "c_mktsegment"), "o_custkey", "c_custkey")])
    suppliers = J.star_join(t("supplier").select("s_suppkey", "s_nationkey"), [(t("nation").select("n_nationkey", "n_name"), "s_nationkey", "n_nationkey")])
    dims = [
        (t("part").select("p_partkey", "p_type"), "l_partkey", "p_partkey"),
        (suppliers.drop("s_nationkey"), "l_suppkey", "s_suppkey"),
        (orders.drop("o_custkey"), "l_orderkey", "o_orderkey"),
    ]
    return J.star_join(fact, dims).groupBy("c_mktsegment", "p_type", "n_name").agg(
        rows(), F.sum("l_quantity").alias("sum_quantity")
    )


@query("""SELECT n_name, COUNT(*) AS rows FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = J.small(table(spark, sf_dir, "nation"))
    return table(spark, sf_dir, "supplier").join(dim, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(rows())


@query(f"""WITH {SALES}, {NATIONS} SELECT n_name, COUNT(*) AS rows,
COUNT(*) FILTER (WHERE from_nation = n_nationkey) AS departures, COUNT(*) FILTER (WHERE to_nation = n_nationkey) AS arrivals,
{mean('fare')} AS avg_fare FROM sales JOIN nations ON n_nationkey IN (1, 7, 13)
AND (from_nation = n_nationkey OR to_nation = n_nationkey) GROUP BY n_name""")
def join_on_either_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = nations(spark, sf_dir).filter(F.col("n_nationkey").isin(1, 7, 13))
    df = J.join_any_key(sales(spark, sf_dir), J.small(hubs), {"from": "from_nation", "to": "to_nation"}, "n_nationkey")
    return df.groupBy("n_name").agg(
        rows(), F.count_if("via_from").alias("departures"), F.count_if("via_to").alias("arrivals"),
        avg_money("fare").alias("avg_fare"),
    )


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unused_dimension_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return J.unused_dims(docs, table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS
(SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def not_in_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right side holds NULL keys, which must not empty the result."""
    good = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, F.col("doc_id")).alias("doc_id"))
    return J.not_in(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), good, "doc_id")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pending orders, which the parent table does not hold yet."""
    parents = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return J.orphans(lines, parents, "l_orderkey", "o_orderkey")


@query(f"""WITH per AS (SELECT l_suppkey, SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS r FROM lineitem GROUP BY l_suppkey),
m AS (SELECT {mean('r')} AS overall_mean FROM per)
SELECT l_suppkey, CAST(ROUND(r, 2) AS DOUBLE) AS revenue, overall_mean FROM per, m WHERE r > overall_mean""")
def above_average_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum(exact("l_extendedprice")).alias("r")
    )
    return J.above_average(per, "r").select("l_suppkey", F.round("r", 2).cast("double").alias("revenue"), "overall_mean")


@query(f"""WITH {SALES}, a AS (SELECT from_nation AS nation, COUNT(*) AS departures FROM sales WHERE rate = 'A' AND from_nation <> 3 GROUP BY 1),
b AS (SELECT to_nation AS nation, COUNT(*) AS arrivals FROM sales WHERE rate = 'R' AND to_nation <> 5 GROUP BY 1)
SELECT nation, COALESCE(departures, 0) AS departures, COALESCE(arrivals, 0) AS arrivals FROM a FULL JOIN b USING (nation)""")
def full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir)
    a = df.filter("rate = 'A' and from_nation <> 3").groupBy(F.col("from_nation").alias("nation")).agg(F.count(F.lit(1)).alias("departures"))
    b = df.filter("rate = 'R' and to_nation <> 5").groupBy(F.col("to_nation").alias("nation")).agg(F.count(F.lit(1)).alias("arrivals"))
    return J.full_merge(a, b, ["nation"], ["departures", "arrivals"])


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS rows FROM orders GROUP BY 1),
b AS (SELECT CAST(l_shipdate AS DATE) AS day, COUNT(*) AS rows FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT day, COALESCE(a.rows, 0) + COALESCE(b.rows, 0) AS rows FROM a LEFT JOIN b USING (day)""")
def sum_two_daily_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(rows())
    b = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.to_date("l_shipdate").alias("day")).agg(rows())
    return J.sum_sides(a, b, "day", ["rows"])


@query(f"""WITH {EV}, f AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS errors FROM ev WHERE event_type = 'error' GROUP BY 1)
SELECT errors, event_type, COUNT(*) AS rows, {total('value')} AS sum_value
FROM ev JOIN f ON CAST(ts AS DATE) = day GROUP BY ALL""")
def join_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    series = ev.filter("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("errors"))
    return J.join_daily(ev, series, "ts").groupBy("errors", "event_type").agg(rows(), sum_money("value").alias("sum_value"))


def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(
        "c_custkey", F.lit("1998-07-01").cast("date").alias("change_date"), F.lit("MOVED").alias("c_mktsegment")
    )


def customer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, those in debt with a second version."""
    base = open_dimension(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "1990-01-01")
    return scd2_apply(base, customer_changes(spark, sf_dir), "c_custkey", ["c_mktsegment"])


@query("""SELECT CASE WHEN c_acctbal < 0 AND o_orderdate >= TIMESTAMP '1998-07-01' THEN 'MOVED' ELSE c_mktsegment END AS segment,
COUNT(*) AS rows FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def join_version_of_the_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    hist = customer_history(spark, sf_dir).withColumnRenamed("c_custkey", "o_custkey")
    df = J.as_of_version(orders, hist, "o_custkey", "o_orderdate")
    return df.groupBy(F.col("c_mktsegment").alias("segment")).agg(rows())


@query("""SELECT o_orderkey, CASE WHEN c_acctbal < 0 AND o_orderdate >= TIMESTAMP '1998-07-01' THEN 'MOVED' ELSE c_mktsegment END AS segment
FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_version_carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same versions, met by one running value instead of a join."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    hist = customer_history(spark, sf_dir).withColumnRenamed("c_custkey", "o_custkey").select("o_custkey", "valid_from", "valid_to", "c_mktsegment")
    return J.as_of_running(orders, hist, "o_custkey", "o_orderdate", "inner").select("o_orderkey", F.col("c_mktsegment").alias("segment"))


@query("""SELECT l_linenumber, COUNT(*) FILTER (WHERE seen) AS seen_rows, COUNT(*) FILTER (WHERE NOT seen) AS new_rows
FROM (SELECT l_linenumber, EXISTS (SELECT 1 FROM lineitem b WHERE b.l_shipdate < TIMESTAMP '1998-01-01'
  AND b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber) AS seen
  FROM lineitem a WHERE l_shipdate >= TIMESTAMP '1998-01-01') GROUP BY l_linenumber""")
def seen_and_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi and anti join on two keys."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    old, new, keys = df.filter(F.col("l_shipdate") < cut), df.filter(F.col("l_shipdate") >= cut), ["l_orderkey", "l_linenumber"]
    hit = J.seen(new, old, keys).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("seen_rows"))
    miss = J.not_seen(new, old, keys).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("new_rows"))
    return J.full_merge(hit, miss, ["l_linenumber"], ["seen_rows", "new_rows"])


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey, l_linenumber, MAX(l_quantity) AS max_quantity FROM lineitem GROUP BY ALL)
SELECT copies, COUNT(*) AS keys, SUM(max_quantity) AS sum_quantity FROM a JOIN b USING (l_orderkey, l_linenumber) GROUP BY copies""")
def multi_column_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    df = J.dealt(table(spark, sf_dir, "lineitem").select(*keys, "l_quantity"), keys)
    a = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    b = df.groupBy(*keys).agg(F.max("l_quantity").alias("max_quantity"))
    return J.join_on(a, b, keys).groupBy("copies").agg(F.count(F.lit(1)).alias("keys"), F.sum("max_quantity").alias("sum_quantity"))
