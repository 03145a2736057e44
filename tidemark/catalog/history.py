"""Deduplication, versions, upserts and schema change."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import hash_key, query, total
from tidemark.catalog.joins import customer_changes, customer_history
from tidemark.functions.amounts import exact
from tidemark.functions.amounts import total as sum_money
from tidemark.operators import history as H
from tidemark.operators.aggregates import describe_nulls
from tidemark.scratch import scratch_path
from tidemark.sources.bucketed import BucketedTable
from tidemark.tables import table

KEYS = ["l_orderkey", "l_linenumber"]


def rows():
    return F.count(F.lit(1)).alias("rows")


@query("""SELECT l_returnflag, COUNT(*) AS rows FROM (SELECT DISTINCT * FROM (SELECT * FROM lineitem
UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R')) GROUP BY l_returnflag""")
def drop_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    doubled = df.unionByName(df.filter("l_returnflag = 'R'"))
    return H.drop_exact_duplicates(doubled).groupBy("l_returnflag").agg(rows())


_DEDUPED = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER
(PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate {d}, l_partkey {d}, l_suppkey {d}, l_extendedprice {d}) AS rn FROM lineitem) WHERE rn = 1"""


def _one_per_key(spark: SparkSession, sf_dir: str, keep: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*KEYS, "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return H.dedupe(df, KEYS, ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"], keep).drop("l_shipdate")


@query(_DEDUPED.format(d="ASC"))
def keep_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_per_key(spark, sf_dir, "first")


@query(_DEDUPED.format(d="DESC"))
def keep_last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_per_key(spark, sf_dir, "last")


@query("""WITH c AS (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CASE WHEN n >= 4 THEN '4x+' ELSE n || 'x' END AS copies, COUNT(*) AS keys, CAST(SUM(n) AS BIGINT) AS rows FROM c GROUP BY 1""")
def duplicate_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.duplicate_frequency(table(spark, sf_dir, "lineitem"), KEYS)


_VERSIONS = f"""SELECT {hash_key('c_custkey', "'1990-01-01'")} AS version_key, c_custkey, c_mktsegment, DATE '1990-01-01' AS valid_from,
CASE WHEN c_acctbal < 0 THEN DATE '1998-06-30' ELSE DATE '9999-12-31' END AS valid_to, NOT (c_acctbal < 0) AS is_current FROM customer
UNION ALL SELECT {hash_key('c_custkey', "'1998-07-01'")}, c_custkey, 'MOVED', DATE '1998-07-01', DATE '9999-12-31', TRUE FROM customer WHERE c_acctbal < 0"""


@query(_VERSIONS)
def scd2_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes applied a second time change nothing."""
    return H.scd2_apply(customer_history(spark, sf_dir), customer_changes(spark, sf_dir), "c_custkey", ["c_mktsegment"])


@query(_VERSIONS)
def versioned_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_history(spark, sf_dir)


@query("""SELECT segment, is_current, COUNT(*) AS rows FROM (
  SELECT c_mktsegment AS segment, NOT (c_acctbal < 0) AS is_current FROM customer WHERE c_nationkey <> 3
  UNION ALL SELECT 'NEW', TRUE FROM customer WHERE c_nationkey <> 3 AND c_acctbal < 0
  UNION ALL SELECT CASE WHEN c_acctbal < 0 THEN 'NEW' ELSE c_mktsegment END, TRUE FROM customer WHERE c_nationkey = 3) GROUP BY ALL""")
def snapshot_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension without one nation meets a source that has it, where debtors have changed segment."""
    now = table(spark, sf_dir, "customer")
    known = H.open_dimension(now.filter("c_nationkey <> 3").select("c_custkey", "c_mktsegment"), "c_custkey", "1990-01-01")
    segment = F.when(F.col("c_acctbal") < 0, "NEW").otherwise(F.col("c_mktsegment"))
    later = now.select("c_custkey", segment.alias("c_mktsegment"))
    out = H.snapshot(known, later, "c_custkey", ["c_mktsegment"], "2000-01-01")
    return out.groupBy(F.col("c_mktsegment").alias("segment"), "is_current").agg(rows())


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def version_on_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.version_at(customer_history(spark, sf_dir), "1999-03-01").select("c_custkey", "c_mktsegment")


def _merge_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Deduplicated lines, and corrections: some prices raised, some new keys."""
    df = table(spark, sf_dir, "lineitem").withColumn("price", exact("l_extendedprice"))
    target = df.groupBy(*KEYS).agg(F.max("price").alias("price"))
    raised = target.filter("price > 80000").withColumn("price", F.round(F.col("price") * F.lit(Decimal("1.1")), 2).cast("decimal(12,2)"))
    new = target.filter("price < 20000").withColumn("l_orderkey", -1 - F.col("l_orderkey"))
    return target, raised.unionByName(new)


_MERGE = """WITH t AS (SELECT l_orderkey, l_linenumber, MAX(CAST(l_extendedprice AS DECIMAL(12,2))) AS price FROM lineitem GROUP BY ALL),
m AS (SELECT l_orderkey, l_linenumber, CASE WHEN {hit} THEN CAST(ROUND(price * 1.1, 2) AS DECIMAL(12,2)) ELSE price END AS price,
  CASE WHEN {hit} THEN 'updated' ELSE 'unchanged' END AS change FROM t
  UNION ALL SELECT -1 - l_orderkey, l_linenumber, price, 'inserted' FROM t WHERE price < 20000) """


@query(_MERGE.format(hit="price > 80000") + f"SELECT change, l_linenumber, COUNT(*) AS rows, {total('price')} AS sum_price FROM m GROUP BY ALL")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _merge_inputs(spark, sf_dir)
    return H.merge(target, source, KEYS).groupBy("change", "l_linenumber").agg(rows(), sum_money("price").alias("sum_price"))


@query(_MERGE.format(hit="price > 90000") + f"SELECT change, COUNT(*) AS rows, {total('price')} AS sum_price FROM m GROUP BY ALL")
def upsert_on_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _merge_inputs(spark, sf_dir)
    merged = H.merge(target, source, KEYS, F.col("target.price") > 90000)
    return merged.groupBy("change").agg(rows(), sum_money("price").alias("sum_price"))


@query(_MERGE.format(hit="price > 80000") + "SELECT 'unchanged' AS change, COUNT(*) AS rows FROM m")
def upsert_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run of the same upsert changes nothing."""
    target, source = _merge_inputs(spark, sf_dir)
    once = H.merge(target, source, KEYS).drop("change")
    return H.merge_audit(H.merge(once, source, KEYS))


def _bucketed(spark: SparkSession, rows: DataFrame, keys: list[str], label: str) -> BucketedTable:
    kept = BucketedTable(spark, scratch_path(spark, label), keys, 8)
    kept.create(rows)
    return kept


@query(_MERGE.format(hit="price > 80000") + f"SELECT l_linenumber, COUNT(*) AS rows, {total('price')} AS sum_price FROM m GROUP BY ALL")
def upsert_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert twice into a table of buckets; the second time nothing is written."""
    target, source = _merge_inputs(spark, sf_dir)
    kept = _bucketed(spark, target, KEYS, "upsert")
    for _ in range(2):
        kept.merge(source)
    if len(kept.versions()) != 2:
        raise AssertionError("the second upsert wrote a version")
    return kept.read().groupBy("l_linenumber").agg(rows(), sum_money("price").alias("sum_price"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, MAX(CAST(l_extendedprice AS DECIMAL(12,2))) AS price FROM lineitem GROUP BY ALL)
SELECT 'updated' AS change, COUNT(*) AS rows FROM t WHERE price > 80000 UNION ALL
SELECT 'inserted', COUNT(*) FROM t WHERE price < 20000 UNION ALL SELECT 'unchanged', COUNT(*) FROM t WHERE price <= 80000""")
def upsert_in_place_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per kind of change in the buckets that got new files (here all)."""
    target, source = _merge_inputs(spark, sf_dir)
    return _bucketed(spark, target, KEYS, "upsert-audit").merge(source)


@query(_VERSIONS)
def scd2_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions closed and opened bucket by bucket; the same changes again write nothing."""
    first = H.open_dimension(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "1990-01-01")
    kept = _bucketed(spark, first, ["c_custkey"], "scd2")
    for _ in range(2):
        kept.scd2(customer_changes(spark, sf_dir), ["c_mktsegment"])
    if len(kept.versions()) != 2:
        raise AssertionError("the second run wrote a version")
    return kept.read()


@query("""SELECT segment, is_current, COUNT(*) AS rows FROM (
  SELECT c_mktsegment AS segment, NOT (c_acctbal < 0) AS is_current FROM customer WHERE c_nationkey <> 3
  UNION ALL SELECT 'NEW', TRUE FROM customer WHERE c_nationkey <> 3 AND c_acctbal < 0
  UNION ALL SELECT CASE WHEN c_acctbal < 0 THEN 'NEW' ELSE c_mktsegment END, TRUE FROM customer WHERE c_nationkey = 3) GROUP BY ALL""")
def snapshot_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "customer")
    known = H.open_dimension(now.filter("c_nationkey <> 3").select("c_custkey", "c_mktsegment"), "c_custkey", "1990-01-01")
    kept = _bucketed(spark, known, ["c_custkey"], "snapshot")
    segment = F.when(F.col("c_acctbal") < 0, "NEW").otherwise(F.col("c_mktsegment"))
    kept.snapshot(now.select("c_custkey", segment.alias("c_mktsegment")), ["c_mktsegment"], "2000-01-01")
    return kept.read().groupBy(F.col("c_mktsegment").alias("segment"), "is_current").agg(rows())


@query("""SELECT 'channel' AS column_name, 'added' AS change, NULL::VARCHAR AS old_type, 'string' AS new_type, COUNT(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS missing FROM orders
UNION ALL SELECT 'o_orderstatus', 'removed', 'string', NULL, COUNT(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') FROM orders
UNION ALL SELECT 'o_custkey', 'type_changed', 'bigint', 'string', 0""")
def schema_change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that differ between two loads, with the rows of both that lack them."""
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    old = df.filter(F.col("o_orderdate") < cut)
    new = df.filter(F.col("o_orderdate") >= cut).drop("o_orderstatus").withColumns(
        {"channel": F.lit("web"), "o_custkey": F.col("o_custkey").cast("string")}
    )
    diff = H.schema_diff(old, new)
    both = H.union_evolved(old.withColumn("o_custkey", F.col("o_custkey").cast("string")), new, {})
    return diff.join(describe_nulls(both).select("column_name", "missing"), "column_name")


@query("""SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'desk' ELSE 'web' END AS channel, COUNT(*) AS rows FROM orders GROUP BY 1""")
def union_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    new = df.filter(F.col("o_orderdate") >= cut).withColumn("channel", F.lit("web"))
    return H.union_evolved(df.filter(F.col("o_orderdate") < cut), new, {"channel": "desk"}).groupBy("channel").agg(rows())
