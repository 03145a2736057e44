"""Metric registry and dashboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.catalog.aggregates import placed
from tidemark.catalog.base import PLACED, SALES, mean, mean_ratio, query, total
from tidemark.plans import dashboards as D
from tidemark.plans import metrics as M
from tidemark.tables import sales

_MIN = "date_diff('minute', started, ended)"
_RATIO = "CAST({} AS DOUBLE) / NULLIF(CAST({} AS DOUBLE), 0)"

# The SQL twin of every metric, over sales.
SQL = {
    "trips_per_day": "CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT CAST(started AS DATE))",
    "trips_per_hour": "CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT date_trunc('hour', started))",
    "avg_party": mean("CASE WHEN line_no > 0 THEN line_no END"),
    "total_revenue": total("total"),
    "avg_fare": mean("CASE WHEN fare > 0 THEN fare END"),
    "avg_tip_rate": mean_ratio("CASE WHEN fare > 0 AND tip >= 0 THEN CAST(tip AS DOUBLE) / CAST(fare AS DOUBLE) END"),
    "revenue_per_mile": _RATIO.format("SUM(CASE WHEN distance > 0 THEN total END)", "SUM(CASE WHEN distance > 0 THEN distance END)"),
    "avg_distance": mean("CASE WHEN distance > 0 THEN distance END"),
    "avg_duration": mean(f"CASE WHEN ended > started THEN {_MIN} END"),
    "p95_duration": f"round(quantile_cont({_MIN}, 0.95) FILTER (WHERE ended > started AND {_MIN} > 0), 6)",
    "short_rate": "COUNT(*) FILTER (WHERE distance < 5 AND distance >= 0) / NULLIF(COUNT(*) FILTER (WHERE distance >= 0), 0)",
    "trips": "CAST(COUNT(*) AS DOUBLE)",
    "active_origins": "CAST(COUNT(DISTINCT from_nation) AS DOUBLE)",
    "cross_place_rate": "COUNT(*) FILTER (WHERE from_nation <> to_nation) / COUNT(*)",
    "urgent_rate": "COUNT(*) FILTER (WHERE payment = '1-URGENT') / COUNT(*)",
    "avg_tip_urgent": mean("CASE WHEN payment = '1-URGENT' THEN tip END"),
}


_TABLE = f"WITH {SALES} " + " UNION ALL ".join(f"SELECT '{n}' AS metric, {e} AS value FROM sales" for n, e in SQL.items())


@query(_TABLE)
def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metric_table(sales(spark, sf_dir), M.OVERALL)


def _light(name: str) -> str:
    t = M.REGISTRY[name].thresholds
    rules = [("red", "<", t.get("critical_below")), ("red", ">", t.get("critical_above")),
             ("yellow", "<", t.get("warning_below")), ("yellow", ">", t.get("warning_above"))]
    return "".join(f"WHEN metric = '{name}' AND value {op} {edge} THEN '{light}' " for light, op, edge in rules if edge is not None)


@query(f"SELECT metric, value, CASE {' '.join(_light(n) for n in SQL)} ELSE 'green' END AS status FROM ({_TABLE})")
def metric_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metric_status(M.metric_table(sales(spark, sf_dir), M.OVERALL))


@query(f"""WITH {SALES} SELECT CAST(date_trunc('month', started) AS DATE) AS period, vendor, {SQL['total_revenue']} AS value FROM sales GROUP BY ALL""")
def metric_by_month_and_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metric(sales(spark, sf_dir), "total_revenue", ["vendor"], "month")


@query(f"""WITH {SALES} SELECT CAST(date_trunc('week', started) AS DATE) AS period, {SQL['avg_fare']} AS value FROM sales GROUP BY ALL""")
def metric_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metric(sales(spark, sf_dir), "avg_fare", [], "week")


@query(f"""WITH {PLACED} SELECT from_r_name, {SQL['avg_fare']} AS value FROM placed GROUP BY from_r_name""")
def metric_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metric(placed(spark, sf_dir), "avg_fare", ["from_r_name"])


@query(f"""WITH {PLACED}, c AS (SELECT from_r_name, from_nation AS item, CAST(COUNT(*) AS DOUBLE) AS value FROM placed GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY from_r_name ORDER BY value DESC, item) AS INTEGER) AS place FROM c) SELECT * FROM r WHERE place <= 5""")
def metric_top_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metric(placed(spark, sf_dir), "top_origins", ["from_r_name"])


@query(f"""WITH {PLACED}, c AS (SELECT CAST(date_trunc('month', started) AS DATE) AS period, from_r_name, COUNT(*) AS n FROM placed GROUP BY ALL),
p AS (SELECT *, lag(n) OVER (PARTITION BY from_r_name ORDER BY period) AS prev FROM c)
SELECT period, from_r_name, CASE WHEN prev <> 0 THEN CAST(n - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100 END AS value FROM p""")
def metric_period_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metric(placed(spark, sf_dir), "trips_change", ["from_r_name"], "month")


@query(f"""WITH {SALES} SELECT vendor, {SQL['p95_duration']} AS value FROM sales GROUP BY vendor""")
def metric_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metric(sales(spark, sf_dir), "p95_duration", ["vendor"])


@query(f"""WITH {SALES}, m AS (SELECT CAST(date_trunc('month', started) AS DATE) AS period, CAST(COUNT(*) AS DOUBLE) AS value FROM sales GROUP BY 1),
p AS (SELECT *, lag(value) OVER (ORDER BY period) AS prev_value FROM m),
g AS (SELECT *, CASE WHEN prev_value <> 0 THEN (value - prev_value) / prev_value * 100 END AS growth_pct FROM p)
SELECT *, CASE WHEN growth_pct > 0 THEN 'up' WHEN growth_pct < 0 THEN 'down' ELSE 'flat' END AS trend FROM g""")
def metric_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metric_trend(sales(spark, sf_dir), "trips", "month")


@query(f"""WITH {SALES} SELECT COUNT(*) AS trips, {total('total')} AS revenue, {mean('fare')} AS avg_fare, {mean('distance')} AS avg_distance,
CAST(SUM(tip) AS DOUBLE) / CAST(SUM(fare) AS DOUBLE) * 100 AS tip_pct, COUNT(DISTINCT from_nation) AS active_places FROM sales""")
def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.kpis(sales(spark, sf_dir))


@query(f"WITH {SALES} SELECT CAST(started AS DATE) AS day, COUNT(*) AS trips, {total('total')} AS revenue FROM sales GROUP BY 1")
def dashboard_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.trend(sales(spark, sf_dir), "started")


@query(f"""WITH {SALES} SELECT payment, COUNT(*) AS trips, {mean('fare')} AS avg_fare, COUNT(*) / (SELECT COUNT(*) FROM sales) AS share FROM sales GROUP BY payment""")
def dashboard_payment_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.breakdown(sales(spark, sf_dir), "payment")


# The regions, as pivot columns.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(f"""WITH {PLACED} SELECT CAST(started AS DATE) AS day, {', '.join(f"COUNT(*) FILTER (WHERE from_r_name = '{r}') AS \"{r}\"" for r in REGIONS)} FROM placed GROUP BY 1""")
def dashboard_daily_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.daily_by_region(placed(spark, sf_dir), "started", REGIONS)


@query(f"""WITH {PLACED} SELECT from_r_name, {', '.join(f"COUNT(*) FILTER (WHERE to_r_name = '{r}') AS \"{r}\"" for r in REGIONS)} FROM placed GROUP BY 1""")
def dashboard_flow_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.flow_matrix(placed(spark, sf_dir), REGIONS)
