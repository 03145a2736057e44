"""Input tables and the stand-in views the catalog runs on.

Schemas are declared, so a scan needs no footer job and only reads the columns used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.amounts import exact_text
from tidemark.operators.joins import small

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation with its region: the geographic dimension (25 rows at every scale)."""
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trips: start and end date, two places, distance, money, payment.

    Money is decimal, so sums do not depend on the order rows are added in. Orders meet customers
    before lines, so lines are shuffled on the order key at most, and once more on the supplier where suppliers
    are too many to be broadcast.
    """
    orders = table(spark, sf_dir, "orders")
    placed = orders.join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).select(
        "o_orderkey", "o_orderdate", "o_orderpriority", "c_nationkey"
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(small(placed, bound=orders), F.expr("l_orderkey = o_orderkey"))
        .join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
        .selectExpr(
            "l_orderkey as order_key",
            "l_linenumber as line_no",
            "o_orderdate as started",
            "l_shipdate as ended",
            "s_nationkey as from_nation",
            "c_nationkey as to_nation",
            "l_quantity as distance",
            f"{exact_text('l_extendedprice')} as fare",
            f"{exact_text('l_extendedprice * l_discount', 4)} as tip",
            f"{exact_text('l_extendedprice * (1 - l_discount) * (1 + l_tax)', 6)} as total",
            "o_orderpriority as payment",
            "l_returnflag as rate",
            "l_linestatus as vendor",
        )
    )
