"""Scans and sinks. Each writes under the shared scratch folder and reads back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.base import NATIONS, SALES, query, total
from tidemark.functions.amounts import exact
from tidemark.functions.amounts import total as sum_money
from tidemark.operators.projections import enforce, enforce_or_infer
from tidemark.operators.sets import sample_n
from tidemark.scratch import scratch_path
from tidemark.sources import readers, writers
from tidemark.sources.ingest import ingest_new
from tidemark.tables import SCHEMAS, nations, sales, table


def rows() -> Column:
    return F.count(F.lit(1)).alias("rows")


def _order_money() -> Column:
    return sum_money(exact("o_totalprice")).alias("sum_price")


@query("""SELECT l_returnflag, COUNT(*) AS rows, SUM(l_quantity) AS sum_quantity
FROM lineitem GROUP BY l_returnflag""")
def scan_parquet_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readers.read(spark, f"{sf_dir}/linei*.parquet", schema=SCHEMAS["lineitem"])
    return df.groupBy("l_returnflag").agg(rows(), F.sum("l_quantity").alias("sum_quantity"))


def _split_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    old = orders.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    new = orders.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return old, new.withColumn("channel", F.when(F.col("o_custkey") % 2 == 0, "web").otherwise("desk"))


_BY_CHANNEL = f"""SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN {{before}}
  WHEN o_custkey % 2 = 0 THEN 'web' ELSE 'desk' END AS channel,
  COUNT(*) AS rows, {total('CAST(o_totalprice AS DECIMAL(12,2))')} AS sum_price FROM orders GROUP BY 1"""


@query(_BY_CHANNEL.format(before="NULL"))
def scan_merged_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _split_orders(spark, sf_dir)
    out = scratch_path(spark, "merged")
    writers.write_parquet(old, f"{out}/part=old")
    writers.write_parquet(new, f"{out}/part=new")
    return readers.read_merged(spark, out).groupBy("channel").agg(rows(), _order_money())


@query(_BY_CHANNEL.format(before="NULL"))
def append_with_new_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _split_orders(spark, sf_dir)
    out = scratch_path(spark, "evolving")
    writers.append_evolving(old, out)
    return writers.append_evolving(new, out).groupBy("channel").agg(rows(), _order_money())


@query(_BY_CHANNEL.format(before="'unknown'"))
def rewrite_with_new_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _split_orders(spark, sf_dir)
    out = scratch_path(spark, "evolved")
    writers.write_parquet(old, f"{out}/v1")
    df = writers.rewrite_evolved(new, f"{out}/v1", f"{out}/v2", {"channel": "unknown"})
    return df.groupBy("channel").agg(rows(), _order_money())


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv_with_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "csv")
    writers.write_as(table(spark, sf_dir, "customer"), out, "csv")
    return readers.read_csv(spark, out, schema=SCHEMAS["customer"])


@query("""SELECT c_mktsegment, COUNT(*) AS rows, CAST(SUM(c_custkey) AS BIGINT) AS sum_key,
MIN(c_acctbal) AS min_balance FROM customer GROUP BY c_mktsegment""")
def scan_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "csv")
    writers.write_as(table(spark, sf_dir, "customer"), out, "csv")
    df = readers.read_csv(spark, out, infer=True)
    return df.groupBy("c_mktsegment").agg(
        rows(), F.sum("c_custkey").cast("bigint").alias("sum_key"), F.min("c_acctbal").alias("min_balance")
    )


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey,
CAST(s_acctbal AS VARCHAR) AS s_acctbal FROM supplier""")
def scan_csv_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "csv")
    writers.write_as(table(spark, sf_dir, "supplier"), out, "csv")
    return readers.read_csv(spark, out, as_strings=True)


def _untyped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text, with a customer key that is no number on every seventeenth row."""
    bad = F.col("o_orderkey") % 17 == 0
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(bad, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
    )


_ORDER_TYPES = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
    ]
)


@query("""SELECT 'o_orderkey' AS column_name, CAST(0 AS BIGINT) AS failures
UNION ALL SELECT 'o_custkey', COUNT(*) FILTER (WHERE o_orderkey % 17 = 0) FROM orders
UNION ALL SELECT 'o_totalprice', CAST(0 AS BIGINT)""")
def enforce_schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enforce(_untyped_orders(spark, sf_dir), _ORDER_TYPES)[1]


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice
FROM orders""")
def enforce_schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enforce(_untyped_orders(spark, sf_dir), _ORDER_TYPES)[0]


@query("""SELECT 'string' AS key_type, COUNT(*) AS rows FROM orders""")
def enforce_schema_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, fits = enforce_or_infer(_untyped_orders(spark, sf_dir), _ORDER_TYPES)
    return df.agg(F.lit(dict(df.dtypes)["o_custkey"]).alias("key_type"), rows())


@query("""SELECT 'l_quantity' AS column_name, COUNT(*) FILTER (WHERE l_linenumber = 1) AS failures FROM lineitem
UNION ALL SELECT 'l_orderkey', CAST(0 AS BIGINT)""")
def enforce_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines have a quantity with a fraction, which does not fit a whole number."""
    quantity = F.col("l_quantity") + F.when(F.col("l_linenumber") == 1, 0.5).otherwise(0.0)
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", quantity.alias("l_quantity"))
    want = T.StructType([T.StructField("l_quantity", T.LongType()), T.StructField("l_orderkey", T.LongType())])
    return enforce(df, want)[1]


@query(f"""SELECT fmt, o_orderstatus, COUNT(*) AS rows, {total('CAST(o_totalprice AS DECIMAL(12,2))')} AS sum_price
FROM orders, (VALUES ('csv'), ('json')) f(fmt) GROUP BY fmt, o_orderstatus""")
def convert_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = scratch_path(spark, "convert")
    parts = []
    for fmt in ("csv", "json"):
        writers.write_as(df, f"{out}/{fmt}", fmt)
        reader = spark.read.schema(df.schema).option("header", True)
        parts.append(reader.format(fmt).load(f"{out}/{fmt}").withColumn("fmt", F.lit(fmt)))
    return parts[0].unionByName(parts[1]).groupBy("fmt", "o_orderstatus").agg(rows(), _order_money())


@query("""SELECT codec, COUNT(*) AS rows, SUM(l_quantity) AS sum_quantity
FROM lineitem, (VALUES ('none'), ('snappy'), ('gzip'), ('zstd')) c(codec) GROUP BY codec""")
def write_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    out = scratch_path(spark, "codecs")
    for codec in ("none", "snappy", "gzip", "zstd"):
        writers.write_parquet(df, f"{out}/codec={codec}", codec)
    return spark.read.parquet(out).groupBy("codec").agg(rows(), F.sum("l_quantity").alias("sum_quantity"))


@query("SELECT o_orderstatus, COUNT(*) AS rows FROM orders GROUP BY o_orderstatus")
def overwrite_is_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "overwrite")
    for _ in range(2):
        writers.overwrite(table(spark, sf_dir, "orders"), out)
    return spark.read.parquet(out).groupBy("o_orderstatus").agg(rows())


def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumns(
        {"year": F.year("o_orderdate"), "month": F.month("o_orderdate")}
    )


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
COUNT(*) AS rows FROM orders GROUP BY ALL""")
def write_partitioned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "partitioned")
    writers.write_partitioned(_dated_orders(spark, sf_dir), out, ["year", "month"])
    return readers.partition_rows(spark.read.parquet(out), ["year", "month"])


@query(f"""SELECT o_orderstatus, COUNT(*) AS rows, {total('CAST(o_totalprice AS DECIMAL(12,2))')} AS sum_price
FROM orders WHERE year(o_orderdate) = 1998 AND month(o_orderdate) BETWEEN 1 AND 6 GROUP BY o_orderstatus""")
def read_pruned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "pruned")
    writers.write_partitioned(_dated_orders(spark, sf_dir), out, ["year", "month"])
    wanted = (F.col("year") == 1998) & F.col("month").between(1, 6)
    return readers.read_partition(spark, out, wanted).groupBy("o_orderstatus").agg(rows(), _order_money())


@query("""SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS period, COUNT(*) AS rows
FROM orders WHERE NOT (year(o_orderdate) = 1997 AND month(o_orderdate) = 3 AND o_orderstatus = 'P')
GROUP BY 1""")
def overwrite_one_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all months, then rerun March 1997 without its pending orders."""
    df = _dated_orders(spark, sf_dir).withColumn("period", F.col("year") * 100 + F.col("month"))
    out = scratch_path(spark, "period")
    writers.write_period(df, out, "period")
    writers.write_period(df.filter("period = 199703 and o_orderstatus <> 'P'"), out, "period")
    return readers.partition_rows(spark.read.parquet(out), ["period"])


@query("""SELECT 'lineitem.parquet' AS _source_file, 'b-1' AS _batch_id, 'trips' AS _type, COUNT(*) AS rows
FROM lineitem""")
def bronze_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readers.stamp(table(spark, sf_dir, "lineitem"), "b-1", "trips")
    return df.filter(F.col("_ingested_at").isNotNull()).groupBy("_source_file", "_batch_id", "_type").agg(rows())


@query("""SELECT event_type, COUNT(*) AS rows, CAST(SUM(event_id) AS BIGINT) AS sum_id FROM events GROUP BY event_type""")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of files; the second repeats part of the first."""
    df = table(spark, sf_dir, "events")
    base = scratch_path(spark, "ingest")
    early = F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")
    overlap = F.col("ts") < F.lit("2024-01-06").cast("timestamp_ntz")

    def land(name: str, part: DataFrame) -> None:
        part.write.mode("append").parquet(f"{base}/landing/{name}")

    args = (f"{base}/landing/*", f"{base}/table", f"{base}/checkpoint", SCHEMAS["events"], ["event_id"], ["ts"])
    land("first", df.filter(early))
    ingest_new(spark, *args)
    land("second", df.filter(~early).unionByName(df.filter(overlap)))
    ingest_new(spark, *args)
    ingest_new(spark, *args)
    return spark.read.parquet(f"{base}/table").groupBy("event_type").agg(rows(), F.sum("event_id").alias("sum_id"))


@query("""SELECT event_type, COUNT(*) AS rows, CAST(SUM(event_id) AS BIGINT) AS sum_id FROM events GROUP BY event_type""")
def ingest_with_new_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second round has lost its checkpoint: it reads all files again, adds what is new and loses nothing."""
    df = table(spark, sf_dir, "events")
    base = scratch_path(spark, "ingest")
    early = F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")
    for i, part in enumerate((early, ~early)):
        df.filter(part).write.parquet(f"{base}/landing/{i}")
        ingest_new(spark, f"{base}/landing/*", f"{base}/table", f"{base}/checkpoint-{i}", SCHEMAS["events"], ["event_id"], ["ts"])
    return spark.read.parquet(f"{base}/table").groupBy("event_type").agg(rows(), F.sum("event_id").alias("sum_id"))


@query(f"""WITH {SALES}, {NATIONS} SELECT n.r_name, s.payment, COUNT(*) AS rows, {total('s.total')} AS revenue
FROM sales s JOIN nations n ON s.from_nation = n.n_nationkey GROUP BY ALL HAVING COUNT(*) > 1""")
def sql_over_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    readers.register_views({"v_sales": sales(spark, sf_dir), "v_nations": nations(spark, sf_dir)})
    return spark.sql(
        "SELECT n.r_name, s.payment, count(*) AS rows, cast(round(sum(s.total), 2) AS double) AS revenue "
        "FROM v_sales s JOIN v_nations n ON s.from_nation = n.n_nationkey "
        "GROUP BY n.r_name, s.payment HAVING count(*) > 1"
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
ORDER BY md5(concat_ws('~', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
  CAST(l_suppkey AS VARCHAR))), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 500""")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return sample_n(table(spark, sf_dir, "lineitem").select(*keys), 500, 42, keys)


@query("""SELECT COUNT(*) AS rows, SUM(l_quantity) AS sum_quantity FROM lineitem
WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'""")
def read_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "clustered")
    df = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_quantity")
    writers.write_clustered(df, out, ["l_shipdate", "l_orderkey"], 8)
    days = [F.lit(d).cast("timestamp_ntz") for d in ("1997-01-01", "1997-03-31")]
    return spark.read.parquet(out).filter(F.col("l_shipdate").between(*days)).agg(
        rows(), F.sum("l_quantity").alias("sum_quantity")
    )


@query("""SELECT 'by_day' AS side, COUNT(*) AS rows, SUM(l_quantity) AS sum_quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'
UNION ALL SELECT 'by_part', COUNT(*), SUM(l_quantity) FROM lineitem WHERE l_partkey BETWEEN 10 AND 20""")
def read_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One copy of the lines serves filters on the day and on the part."""
    out = scratch_path(spark, "interleaved")
    writers.write_interleaved(table(spark, sf_dir, "lineitem").select("l_shipdate", "l_partkey", "l_quantity"), out, ["l_shipdate", "l_partkey"], 16)
    days = [F.lit(d).cast("timestamp_ntz") for d in ("1997-01-01", "1997-03-31")]
    sides = {"by_day": F.col("l_shipdate").between(*days), "by_part": F.col("l_partkey").between(10, 20)}
    found = [spark.read.parquet(out).filter(c).agg(F.lit(n).alias("side"), rows(), F.sum("l_quantity").alias("sum_quantity")) for n, c in sides.items()]
    return found[0].unionAll(found[1])


@query("SELECT o_orderpriority, COUNT(*) AS rows FROM orders GROUP BY o_orderpriority")
def compact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "compact")
    writers.write_parquet(table(spark, sf_dir, "orders").repartition(16), f"{out}/many")
    writers.compact(spark.read.parquet(f"{out}/many"), f"{out}/few", 2)
    return spark.read.parquet(f"{out}/few").groupBy("o_orderpriority").agg(rows())
