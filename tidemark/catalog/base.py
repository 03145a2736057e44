"""Query registry, and SQL fragments shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark import tables
from tidemark.functions.amounts import exact

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name."""
    def add(run: Run) -> Run:
        if run.__name__ in REGISTRY:
            raise ValueError(f"{run.__name__} is registered twice")
        REGISTRY[run.__name__] = Query(run, sql)
        return run

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the value as decimal."""
    return tables.table(spark, sf_dir, "events").withColumn("value", exact("value"))


SALES = """sales AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_no, o_orderdate AS started, l_shipdate AS ended,
    s_nationkey AS from_nation, c_nationkey AS to_nation, l_quantity AS distance,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS fare,
    CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS tip,
    CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
      * (1 + CAST(l_tax AS DECIMAL(4,2))) AS total,
    o_orderpriority AS payment, l_returnflag AS rate, l_linestatus AS vendor
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
NATIONS = """nations AS (
  SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""
EV = """ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(12,2)) AS value FROM events)"""
PLACED = f"""{SALES}, {NATIONS}, placed AS (
  SELECT s.*, a.n_name AS from_n_name, a.r_name AS from_r_name, b.n_name AS to_n_name, b.r_name AS to_r_name
  FROM sales s JOIN nations a ON from_nation = a.n_nationkey JOIN nations b ON to_nation = b.n_nationkey)"""


def total(x: str) -> str:
    return f"CAST(ROUND(SUM({x}), 2) AS DOUBLE)"


def mean(x: str, more: str = "") -> str:
    return f"CAST(SUM({x}){more} AS DOUBLE) / NULLIF(COUNT({x}){more}, 0)"


def mean_over(x: str, frame: str) -> str:
    return f"CAST(SUM({x}) OVER ({frame}) AS DOUBLE) / NULLIF(COUNT({x}) OVER ({frame}), 0)"


def mean_ratio(x: str, scale: str = "") -> str:
    """Plain mean, rounded at the output only."""
    return f"ROUND(AVG({x}){scale}, 9)"


def hash_key(*columns: str) -> str:
    """SQL twin of the surrogate key: every part preceded by its length, '-' for a null."""
    texts = [f"CAST({c} AS VARCHAR)" for c in columns]
    return "md5(" + " || ".join(f"COALESCE(length({t}) || ':' || {t}, '-')" for t in texts) + ")"
