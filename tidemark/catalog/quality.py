"""Data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import NATIONS, SALES, query, total
from tidemark.catalog.scalars import NULLED, with_nulls
from tidemark.functions.amounts import total as sum_money
from tidemark.operators import profile as P
from tidemark.operators import quality as Q
from tidemark.tables import nations, sales, table

AS_OF = "2002-01-01 00:00:00"


def rows():
    return F.count(F.lit(1)).alias("rows")


@query("""SELECT CASE WHEN l_shipdate < o_orderdate THEN 'backwards' WHEN l_extendedprice > 90000 THEN 'too_dear' END AS reason,
COUNT(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def valid_and_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("backwards", F.col("ended") >= F.col("started")), ("too_dear", F.col("fare") <= 90000)]
    valid, bad = Q.split(sales(spark, sf_dir), rules)
    return valid.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).groupBy("reason").agg(rows())


_CASCADE = f"""WITH {SALES}, c AS (SELECT *, CASE WHEN ended < started THEN 'backwards' WHEN tip = 0 THEN 'no_tip'
  WHEN fare > 80000 THEN 'too_dear' WHEN from_nation = to_nation THEN 'same_place' END AS rule FROM sales)"""


def _cascade() -> list:
    return [
        ("backwards", F.col("ended") >= F.col("started")),
        ("no_tip", F.col("tip") != 0),
        ("too_dear", F.col("fare") <= 80000),
        ("same_place", F.col("from_nation") != F.col("to_nation")),
    ]


@query(f"""{_CASCADE} SELECT CAST(CASE rule WHEN 'backwards' THEN 1 WHEN 'no_tip' THEN 2 WHEN 'too_dear' THEN 3 ELSE 4 END AS INTEGER) AS step,
rule, COUNT(*) AS dropped FROM c WHERE rule IS NOT NULL GROUP BY rule""")
def cleaning_drops_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.clean(sales(spark, sf_dir), _cascade())[1]


@query(f"{_CASCADE} SELECT payment, COUNT(*) AS rows, {total('total')} AS revenue FROM c WHERE rule IS NULL GROUP BY payment")
def cleaned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.clean(sales(spark, sf_dir), _cascade())[0].groupBy("payment").agg(rows(), sum_money("total").alias("revenue"))


def _profile_sql(source: str, columns: dict[str, bool]) -> str:
    parts = []
    for c, numeric in columns.items():
        n = f"CAST({c} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, COUNT(*) AS total, COUNT(*) - COUNT({c}) AS nulls, (COUNT(*) - COUNT({c})) / COUNT(*) * 100 AS null_pct, "
            f"COUNT(DISTINCT {c}) AS distinct_values, CAST(MIN({c}) AS VARCHAR) AS min_value, CAST(MAX({c}) AS VARCHAR) AS max_value, "
            f"ROUND(AVG({n}), 6) AS mean_value, ROUND(stddev_samp({n}), 4) AS std_value, COUNT(*) FILTER (WHERE {n} < 0) AS negatives FROM {source}"
        )
    return " UNION ALL ".join(parts)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"mean_value": F.round("mean_value", 6), "std_value": F.round("std_value", 4)})


@query(_profile_sql("customer", {"c_custkey": True, "c_name": False, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False}))
def profile_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.profile(table(spark, sf_dir, "customer"), exact_distinct=True))


@query(f"WITH {NULLED} " + _profile_sql("nulled", {"l_quantity": True, "l_extendedprice": True, "l_returnflag": False, "l_shipdate": False}))
def profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_nulls(spark, sf_dir).select("l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    return _rounded(P.profile(df, exact_distinct=True))


@query("""SELECT * FROM (SELECT 'o_orderpriority' AS column_name, o_orderpriority AS value, COUNT(*) AS occurrences FROM orders GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) AS v, COUNT(*) AS n FROM orders GROUP BY 2 ORDER BY n DESC, v LIMIT 3)""")
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_values(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_custkey"], 3)


@query("""SELECT * FROM (SELECT DISTINCT 'p_brand' AS column_name, p_brand AS value FROM part ORDER BY p_brand LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'p_size', CAST(v AS VARCHAR) FROM (SELECT DISTINCT p_size AS v FROM part ORDER BY v LIMIT 3))""")
def profile_sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sample_values(table(spark, sf_dir, "part"), ["p_brand", "p_size"], 3)


@query("""SELECT 'rows' AS scope, (SELECT COUNT(*) FROM lineitem) AS rows, (SELECT COUNT(*) FROM lineitem) - COUNT(*) AS duplicates FROM (SELECT DISTINCT * FROM lineitem)
UNION ALL SELECT 'keys', (SELECT COUNT(*) FROM lineitem), (SELECT COUNT(*) FROM lineitem) - COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def profile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    by_row = P.duplicate_rows(df).withColumn("scope", F.lit("rows"))
    return by_row.unionByName(P.duplicate_rows(df, ["l_orderkey", "l_linenumber"]).withColumn("scope", F.lit("keys")))


_DOMAIN = {"negative_balance": "c_acctbal < 0", "tiny_balance": "abs(c_acctbal) < 1", "no_segment": "c_mktsegment IS NULL"}


@query(" UNION ALL ".join(
    f"SELECT '{n}' AS rule, COUNT(*) FILTER (WHERE {c}) AS hits, COUNT(*) FILTER (WHERE {c}) / COUNT(*) * 100 AS pct FROM customer"
    for n, c in _DOMAIN.items()
))
def profile_domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.domain_checks(table(spark, sf_dir, "customer"), {n: F.expr(c) for n, c in _DOMAIN.items()})


LINE_RULES = [
    {"check": "completeness", "column": "l_orderkey"},
    {"check": "completeness", "column": "l_quantity", "max_null_pct": 5.0},
    {"check": "completeness", "column": "l_returnflag", "max_null_pct": 50.0},
    {"check": "uniqueness", "column": "l_orderkey"},
    {"check": "range", "column": "l_quantity", "min": 1, "max": 40},
    {"check": "range", "column": "l_extendedprice", "min": 0},
    {"check": "pattern", "column": "l_linestatus", "pattern": "[OF]"},
    {"check": "accepted_values", "column": "l_returnflag", "values": ["A", "N"]},
]


def _check_sql(check: str, column: str, failing: str, source: str, allowed: float = 0.0) -> str:
    pct = f"({failing}) / COUNT(*) * 100"
    return (
        f"SELECT '{check}' AS \"check\", '{column}' AS column_name, {pct} <= {allowed} AS passed, COUNT(*) AS total_rows, "
        f"{failing} AS failing_rows, {pct} AS failure_pct FROM {source}"
    )


_LINE_CHECKS = " UNION ALL ".join(
    [
        _check_sql("completeness", "l_orderkey", "COUNT(*) FILTER (WHERE l_orderkey IS NULL)", "nulled"),
        _check_sql("completeness", "l_quantity", "COUNT(*) FILTER (WHERE l_quantity IS NULL)", "nulled", 5.0),
        _check_sql("completeness", "l_returnflag", "COUNT(*) FILTER (WHERE l_returnflag IS NULL)", "nulled", 50.0),
        _check_sql("uniqueness", "l_orderkey", "COUNT(l_orderkey) - COUNT(DISTINCT l_orderkey)", "nulled"),
        _check_sql("range", "l_quantity", "COUNT(*) FILTER (WHERE l_quantity NOT BETWEEN 1 AND 40)", "nulled"),
        _check_sql("range", "l_extendedprice", "COUNT(*) FILTER (WHERE l_extendedprice < 0)", "nulled"),
        _check_sql("pattern", "l_linestatus", "COUNT(*) FILTER (WHERE l_linestatus NOT IN ('O', 'F'))", "nulled"),
        _check_sql("accepted_values", "l_returnflag", "COUNT(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N'))", "nulled"),
    ]
)


@query(f"WITH {NULLED} {_LINE_CHECKS}")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.run_checks(with_nulls(spark, sf_dir), LINE_RULES)


@query("""SELECT 'unique' AS test, 'o_orderkey' AS column_name, COUNT(o_orderkey) - COUNT(DISTINCT o_orderkey) AS failing_rows, COUNT(o_orderkey) = COUNT(DISTINCT o_orderkey) AS passed FROM orders
UNION ALL SELECT 'not_null', 'o_orderkey', 0, TRUE
UNION ALL SELECT 'accepted_values', 'o_orderstatus', COUNT(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')), COUNT(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) = 0 FROM orders
UNION ALL SELECT 'relationships', 'o_custkey', COUNT(DISTINCT o_custkey), COUNT(*) = 0 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def schema_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    tests = {
        "o_orderkey": ["unique", "not_null"],
        "o_orderstatus": [("accepted_values", ["O", "F"])],
        "o_custkey": ["relationships"],
    }
    return Q.schema_tests(table(spark, sf_dir, "orders"), tests, {"o_custkey": (some, "c_custkey")})


_ORPHANS = """SELECT '{name}' AS relationship, COUNT(DISTINCT {key}) AS child_keys, COUNT(DISTINCT {key}) FILTER (WHERE {lost}) AS orphan_keys,
COUNT(DISTINCT {key}) FILTER (WHERE {lost}) / COUNT(DISTINCT {key}) * 100 AS orphan_pct, COUNT(*) FILTER (WHERE {lost}) = 0 AS passed,
COALESCE((SELECT string_agg(k, ',') FROM (SELECT k FROM (SELECT DISTINCT {key} AS k FROM {child} WHERE {lost} ORDER BY 1 LIMIT 10) ORDER BY k)), '') AS samples FROM {child}"""


@query(" UNION ALL ".join([
    _ORPHANS.format(name="lines.order", key="l_orderkey", lost="l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')", child="lineitem"),
    _ORPHANS.format(name="orders.customer", key="o_custkey", lost="FALSE", child="orders"),
    _ORPHANS.format(name="lines.part", key="l_partkey", lost="FALSE", child="lineitem"),
    _ORPHANS.format(name="lines.supplier", key="l_suppkey", lost="l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)", child="lineitem"),
]))
def referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    links = [
        (t("lineitem"), "l_orderkey", t("orders").filter("o_orderstatus <> 'P'"), "o_orderkey", "lines.order"),
        (t("orders"), "o_custkey", t("customer"), "c_custkey", "orders.customer"),
        (t("lineitem"), "l_partkey", t("part"), "p_partkey", "lines.part"),
        (t("lineitem"), "l_suppkey", t("supplier").filter("s_acctbal >= 0"), "s_suppkey", "lines.supplier"),
    ]
    found = [Q.referential(*link) for link in links]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query(f"""WITH {SALES} SELECT 'positive_fare' AS test, COUNT(*) FILTER (WHERE fare < 0) AS failing_rows, COUNT(*) FILTER (WHERE fare < 0) = 0 AS passed FROM sales
UNION ALL SELECT 'valid_duration', COUNT(*) FILTER (WHERE ended < started), COUNT(*) FILTER (WHERE ended < started) = 0 FROM sales""")
def row_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir)
    return Q.assert_empty(df.filter("fare < 0"), "positive_fare").unionByName(
        Q.assert_empty(df.filter("ended < started"), "valid_duration")
    )


_AGE = "(epoch(TIMESTAMP '2002-01-01') - floor(epoch(MAX({ts})))) / 86400"


@query(" UNION ALL ".join(
    f"SELECT '{n}' AS dataset, MAX({ts}) AS latest, {_AGE.format(ts=ts)} AS age_days, CASE WHEN {_AGE.format(ts=ts)} <= {slo} THEN 'PASS' ELSE 'STALE' END AS status FROM {n}"
    for n, ts, slo in (("orders", "o_orderdate", 30), ("lineitem", "l_shipdate", 365))
))
def freshness_against_slo(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Q.freshness(table(spark, sf_dir, "orders"), "o_orderdate", 30, AS_OF, "orders")
    return a.unionByName(Q.freshness(table(spark, sf_dir, "lineitem"), "l_shipdate", 365, AS_OF, "lineitem"))


@query("""SELECT 'orders' AS dataset, COUNT(*) AS rows, COUNT(*) BETWEEN 1000 AND 1000000000000 AS passed FROM orders
UNION ALL SELECT 'nation', COUNT(*), COUNT(*) BETWEEN 30 AND 100 FROM nation""")
def volume_within_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Q.volume_check(table(spark, sf_dir, "orders"), 1000, 10**12, "orders")
    return a.unionByName(Q.volume_check(table(spark, sf_dir, "nation"), 30, 100, "nation"))


@query("""WITH a AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, COUNT(*) AS rows_a FROM lineitem GROUP BY 1),
b AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS rows_b FROM orders GROUP BY 1)
SELECT month, rows_a, rows_b, rows_a / rows_b AS ratio FROM a JOIN b USING (month)""")
def volume_ratio_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = lambda c: F.trunc(F.to_date(c), "month").alias("month")
    return Q.volume_ratio(
        table(spark, sf_dir, "lineitem").select(month("l_shipdate")), table(spark, sf_dir, "orders").select(month("o_orderdate")), "month"
    )


CONTRACT = {
    "schema": [
        {"name": "l_orderkey", "type": "integer", "nullable": False},
        {"name": "l_linenumber", "type": "string", "nullable": False, "unique": True},
        {"name": "l_quantity", "type": "float", "nullable": False},
        {"name": "l_shipmode", "type": "string"},
    ],
    "quality_rules": [
        {"column": "l_quantity", "rule": "range", "min": 1, "max": 30, "severity": "error"},
        {"column": "l_returnflag", "rule": "accepted_values", "values": ["A", "N", "R"], "severity": "warning"},
        {"column": "l_linestatus", "rule": "pattern", "pattern": "O", "severity": "warning"},
        {"column": "l_comment", "rule": "pattern", "pattern": ".*", "severity": "warning"},
    ],
    "freshness": {"timestamp_column": "l_shipdate", "max_delay_hours": 24 * 365},
    "volume": {"min_rows": 100, "max_rows": 5000},
}

_CONTRACT = f"""WITH {NULLED}, r AS (
SELECT 'column_exists' AS "check", 'l_orderkey' AS column_name, 'error' AS severity, CAST(0 AS BIGINT) AS failing_rows, TRUE AS passed
UNION ALL SELECT 'type_matches', 'l_orderkey', 'error', 0, TRUE
UNION ALL SELECT 'column_exists', 'l_linenumber', 'error', 0, TRUE
UNION ALL SELECT 'type_matches', 'l_linenumber', 'error', 1, FALSE
UNION ALL SELECT 'column_exists', 'l_quantity', 'error', 0, TRUE
UNION ALL SELECT 'type_matches', 'l_quantity', 'error', 0, TRUE
UNION ALL SELECT 'column_exists', 'l_shipmode', 'error', 1, FALSE
UNION ALL SELECT 'pattern', 'l_comment', 'warning', 1, FALSE
UNION ALL SELECT 'not_nullable', 'l_orderkey', 'error', COUNT(*) FILTER (WHERE l_orderkey IS NULL), COUNT(*) FILTER (WHERE l_orderkey IS NULL) = 0 FROM nulled
UNION ALL SELECT 'not_nullable', 'l_linenumber', 'error', COUNT(*) FILTER (WHERE l_linenumber IS NULL), COUNT(*) FILTER (WHERE l_linenumber IS NULL) = 0 FROM nulled
UNION ALL SELECT 'not_nullable', 'l_quantity', 'error', COUNT(*) FILTER (WHERE l_quantity IS NULL), COUNT(*) FILTER (WHERE l_quantity IS NULL) = 0 FROM nulled
UNION ALL SELECT 'unique', 'l_linenumber', 'error', COUNT(l_linenumber) - COUNT(DISTINCT l_linenumber), COUNT(l_linenumber) = COUNT(DISTINCT l_linenumber) FROM nulled
UNION ALL SELECT 'range', 'l_quantity', 'error', COUNT(*) FILTER (WHERE l_quantity NOT BETWEEN 1 AND 30), COUNT(*) FILTER (WHERE l_quantity NOT BETWEEN 1 AND 30) = 0 FROM nulled
UNION ALL SELECT 'accepted_values', 'l_returnflag', 'warning', COUNT(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R')), COUNT(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R')) = 0 FROM nulled
UNION ALL SELECT 'pattern', 'l_linestatus', 'warning', COUNT(*) FILTER (WHERE l_linestatus <> 'O'), COUNT(*) FILTER (WHERE l_linestatus <> 'O') = 0 FROM nulled
UNION ALL SELECT 'freshness', 'l_shipdate', 'error', CAST((epoch(TIMESTAMP '2002-01-01') - epoch(MAX(l_shipdate))) / 3600 > 8760 AS BIGINT), (epoch(TIMESTAMP '2002-01-01') - epoch(MAX(l_shipdate))) / 3600 <= 8760 FROM nulled
UNION ALL SELECT 'volume', '*', 'error', CAST(COUNT(*) NOT BETWEEN 100 AND 5000 AS BIGINT), COUNT(*) BETWEEN 100 AND 5000 FROM nulled)"""


@query(f"{_CONTRACT} SELECT * FROM r")
def contract_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validate_contract(with_nulls(spark, sf_dir), CONTRACT, AS_OF)


@query(f"""{_CONTRACT} SELECT COUNT(*) AS checks, COUNT(*) FILTER (WHERE passed) AS passed_checks, COUNT(*) FILTER (WHERE NOT passed) AS failed_checks,
COUNT(*) FILTER (WHERE passed) / COUNT(*) * 100 AS compliance_pct FROM r WHERE "check" NOT IN ('freshness', 'volume')""")
def contract_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.compliance(Q.validate_contract(with_nulls(spark, sf_dir), CONTRACT, AS_OF))


# Two range rules on one column, and a column that is both promised and checked.
TWO_RANGES = {
    "schema": [{"name": "o_totalprice", "nullable": False}],
    "quality_rules": [
        {"rule": "range", "column": "o_totalprice", "min": 0, "severity": "error"},
        {"rule": "range", "column": "o_totalprice", "max": 100000, "severity": "warning"},
        {"rule": "completeness", "column": "o_totalprice", "max_null_pct": 5.0, "severity": "info"},
    ],
}


@query("""WITH n AS (SELECT COUNT(*) FILTER (WHERE o_totalprice IS NULL) AS missing, COUNT(*) FILTER (WHERE o_totalprice < 0) AS low,
  COUNT(*) FILTER (WHERE o_totalprice > 100000) AS high, COUNT(*) AS rows FROM orders)
SELECT 'column_exists' AS "check", 'o_totalprice' AS column_name, 'error' AS severity, CAST(0 AS BIGINT) AS failing_rows, TRUE AS passed
UNION ALL SELECT 'not_nullable', 'o_totalprice', 'error', missing, missing = 0 FROM n
UNION ALL SELECT 'range', 'o_totalprice', 'error', low, low = 0 FROM n
UNION ALL SELECT 'range', 'o_totalprice', 'warning', high, high = 0 FROM n
UNION ALL SELECT 'completeness', 'o_totalprice', 'info', missing, missing * 100 <= 5 * rows FROM n""")
def contract_two_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validate_contract(table(spark, sf_dir, "orders"), TWO_RANGES, AS_OF)


@query("""SELECT 'text' AS dataset, CAST(round(COUNT(*) FILTER (WHERE o_custkey % 7 <> 0 AND o_totalprice <= 100000) / COUNT(*) * 100, 4) AS DOUBLE) AS validity FROM orders""")
def score_text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as text; every seventh customer's are no numbers, which do not pass a range rule."""
    price = F.when(F.col("o_custkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", price.alias("price"))
    spec = {"validity": [{"check": "range", "column": "price", "min": 0, "max": 100000}], "timestamp": "o_orderdate", "max_age_days": 90}
    return Q.score(df, spec, AS_OF, "text").select("dataset", F.round("validity", 4).alias("validity"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean, a repeated and a late dataset."""
    orders = {
        "required": ["o_orderkey", "o_custkey"], "keys": ["o_orderkey"],
        "validity": [{"check": "range", "column": "o_totalprice", "min": 0}],
        "formats": [{"check": "pattern", "column": "o_orderpriority", "pattern": "[1-5]-"}],
        "timestamp": "o_orderdate", "max_age_days": 90,
    }
    lines = {
        "required": ["l_orderkey", "l_quantity", "l_returnflag"], "keys": ["l_orderkey", "l_linenumber"],
        "validity": [
            {"check": "range", "column": "l_quantity", "min": 1, "max": 40},
            {"check": "accepted_values", "column": "l_returnflag", "values": ["A", "N"]},
        ],
        "formats": [{"check": "pattern", "column": "l_linestatus", "pattern": "O"}],
        "timestamp": "l_shipdate", "max_age_days": 30,
    }
    a = Q.score(table(spark, sf_dir, "orders"), orders, AS_OF, "orders")
    return a.unionByName(Q.score(with_nulls(spark, sf_dir), lines, AS_OF, "lines"))


_SCORES = f"""{NULLED}, o AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderkey IS NULL) + COUNT(*) FILTER (WHERE o_custkey IS NULL) AS miss,
  COUNT(DISTINCT o_orderkey) AS d, COUNT(o_orderkey) AS k, COUNT(*) FILTER (WHERE o_totalprice >= 0) AS v, COUNT(*) FILTER (WHERE regexp_matches(o_orderpriority, '^[1-5]-')) AS f,
  (epoch(TIMESTAMP '2002-01-01') - epoch(MAX(o_orderdate))) / 86400 / 90 AS late FROM orders),
l AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE l_quantity IS NULL) + COUNT(*) FILTER (WHERE l_returnflag IS NULL) AS miss,
  COUNT(DISTINCT l_orderkey) AS d1, COUNT(DISTINCT l_linenumber) AS d2, COUNT(l_quantity) + COUNT(l_returnflag) AS seen,
  COUNT(*) FILTER (WHERE l_quantity BETWEEN 1 AND 40) + COUNT(*) FILTER (WHERE l_returnflag IN ('A', 'N')) AS v, COUNT(*) FILTER (WHERE l_linestatus = 'O') AS f,
  (epoch(TIMESTAMP '2002-01-01') - epoch(MAX(l_shipdate))) / 86400 / 30 AS late FROM nulled),
s AS (SELECT 'orders' AS dataset, (n * 2 - miss) / (n * 2) * 100 AS completeness, d / k * 100 AS uniqueness, v / n * 100 AS validity, f / n * 100 AS consistency,
  CASE WHEN late <= 1 THEN 100.0 ELSE greatest(0.0, (1 - (late - 1) / 2) * 100) END AS timeliness FROM o
  UNION ALL SELECT 'lines', (n * 3 - miss) / (n * 3) * 100, (d1 / n * 100 + d2 / n * 100) / 2, v / seen * 100, f / n * 100,
  CASE WHEN late <= 1 THEN 100.0 ELSE greatest(0.0, (1 - (late - 1) / 2) * 100) END FROM l),
w AS (SELECT *, completeness * 0.3 + uniqueness * 0.2 + validity * 0.25 + consistency * 0.15 + timeliness * 0.1 AS overall FROM s)"""
_DIMS = ("completeness", "uniqueness", "validity", "consistency", "timeliness", "overall")


@query(f"""WITH {_SCORES} SELECT dataset, {', '.join(f'CAST(round({d}, 4) AS DOUBLE) AS {d}' for d in _DIMS)},
CASE WHEN overall >= 95 THEN 'EXCELLENT' WHEN overall >= 85 THEN 'GOOD' WHEN overall >= 70 THEN 'FAIR' WHEN overall >= 50 THEN 'POOR' ELSE 'CRITICAL' END AS grade FROM w""")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).withColumns({d: F.round(d, 4) for d in _DIMS})


@query(f"""WITH {_SCORES} SELECT dataset, CAST(round(overall, 4) AS DOUBLE) AS overall, CASE WHEN overall < 80 THEN 'OPEN' WHEN overall < 90 THEN 'HALF-OPEN' ELSE 'CLOSED' END AS state,
CASE WHEN overall < 50 THEN 'CRITICAL' WHEN overall < 80 THEN 'ERROR' WHEN overall < 90 THEN 'WARNING' ELSE 'INFO' END AS severity FROM w""")
def circuit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.circuit(scores(spark, sf_dir)).withColumn("overall", F.round("overall", 4))


_REPORT = f"""WITH {NULLED}, r AS ({_LINE_CHECKS}), x AS (SELECT 'lines' AS dataset, "check", column_name, failing_rows, failure_pct,
CASE WHEN failure_pct > CASE "check" WHEN 'completeness' THEN 5 WHEN 'uniqueness' THEN 1 WHEN 'range' THEN 5 END THEN 'HIGH'
  WHEN failure_pct > CASE "check" WHEN 'completeness' THEN 1 WHEN 'uniqueness' THEN 0 WHEN 'range' THEN 1 END THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM r WHERE failing_rows > 0)
SELECT CAST(row_number() OVER (ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, failing_rows DESC, dataset, "check", column_name) AS INTEGER) AS place,
dataset, "check", column_name, severity, failing_rows, failure_pct FROM x"""


@query(_REPORT)
def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.issue_report({"lines": Q.run_checks(with_nulls(spark, sf_dir), LINE_RULES)})


@query("""WITH x AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS period, 'l_extendedprice' AS column_name, l_extendedprice AS v FROM lineitem
UNION ALL SELECT CAST(year(l_shipdate) AS INTEGER), 'l_quantity', l_quantity FROM lineitem),
s AS (SELECT period, column_name, COUNT(v) AS rows, AVG(v) AS m, stddev_samp(v) AS sd FROM x GROUP BY ALL)
SELECT period, column_name, rows, round(m, 6) AS mean_value, round(sd, 6) AS std_value,
round((m - lag(m) OVER w) / lag(sd) OVER w, 6) AS z_shift FROM s WINDOW w AS (PARTITION BY column_name ORDER BY period)""")
def drift_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.drift(table(spark, sf_dir, "lineitem"), F.year("l_shipdate"), ["l_extendedprice", "l_quantity"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_value", "std_value", "z_shift")})


@query("""WITH b AS (SELECT CAST(floor(l_extendedprice / 10000) * 10000 AS DOUBLE) AS bin, COUNT(*) FILTER (WHERE l_shipdate < TIMESTAMP '1998-01-01') AS base_rows,
COUNT(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1998-01-01') AS other_rows FROM lineitem GROUP BY 1),
p AS (SELECT *, greatest(base_rows, 1) / SUM(base_rows) OVER () AS p, greatest(other_rows, 1) / SUM(other_rows) OVER () AS q FROM b)
SELECT bin, base_rows, other_rows, round((q - p) * ln(q / p), 10) AS contribution FROM p""")
def stability_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    out = Q.stability_index(table(spark, sf_dir, "lineitem"), early, "l_extendedprice", 10000)
    return out.withColumn("contribution", F.round("contribution", 10))


_ISSUES = {
    "negative_fare": "fare < 0", "short_but_dear": "distance < 2 AND fare > 1000", "backwards": "started > ended",
    "extreme_total": "total > 100000", "same_place": "from_nation = to_nation",
}


@query(f"WITH {SALES} " + " UNION ALL ".join(
    f"SELECT '{n}' AS issue, COUNT(*) FILTER (WHERE {c}) AS issue_count FROM sales" for n, c in _ISSUES.items()
))
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.issue_counts(sales(spark, sf_dir), {n: F.expr(c) for n, c in _ISSUES.items()})


@query(f"""WITH {NATIONS} SELECT 'unique' AS test, 'n_nationkey' AS column_name, CAST(0 AS BIGINT) AS failing_rows, TRUE AS passed
UNION ALL SELECT 'accepted_values', 'r_name', COUNT(*) FILTER (WHERE r_name NOT IN ('ASIA', 'EUROPE')), FALSE FROM nations""")
def dimension_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.schema_tests(nations(spark, sf_dir), {"n_nationkey": ["unique"], "r_name": [("accepted_values", ["ASIA", "EUROPE"])]})


@query("""WITH v AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS period, CAST(l_quantity AS DOUBLE) AS v FROM lineitem),
q AS (SELECT period, 0.25 AS q, quantile_cont(v, 0.25) AS value FROM v GROUP BY 1 UNION ALL SELECT period, 0.5, quantile_cont(v, 0.5) FROM v GROUP BY 1
  UNION ALL SELECT period, 0.9, quantile_cont(v, 0.9) FROM v GROUP BY 1),
p AS (SELECT period, CAST(q AS DOUBLE) AS q, round(value, 6) AS value FROM q), l AS (SELECT *, lag(value) OVER (PARTITION BY q ORDER BY period) AS prev_value FROM p)
SELECT *, round(CASE WHEN prev_value <> 0 THEN (value - prev_value) / prev_value * 100 END, 6) AS change_pct FROM l""")
def drift_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile, median and ninth decile of quantities by year of shipping."""
    out = Q.drift_quantiles(table(spark, sf_dir, "lineitem"), F.year("l_shipdate"), "l_quantity", [0.25, 0.5, 0.9])
    return out.withColumns({"value": F.round("value", 6), "prev_value": F.round("prev_value", 6), "change_pct": F.round("change_pct", 6)})
