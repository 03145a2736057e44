"""Metric registry: each metric is declared once and computed for any dimensions and grain.

A metric is a sum, or one sum over another, or a count of distinct values. All sums are one aggregate
with a group per dimension value. Distinct values are counted in a second one, over rows already grouped
by those values: counting them beside the sums would copy every row, and grouping the sums by them would
send every buffer through the shuffle once per value.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import quantiles
from tidemark.operators.windows import growth
from tidemark.scratch import materialise

GRAINS = ("day", "week", "month")


@dataclass(frozen=True)
class Metric:
    """``num`` is summed over the rows matching ``where``.

    The sum is divided by the sum of ``den`` if given, by the matching rows for an average, or by the
    number of distinct ``per`` values. A distinct count is ``per`` alone. ``digits`` rounds the result of
    a mean of inexact numbers. A ranked metric keeps the ``top`` values of ``per`` in each group, ties to the smaller one;
    a period-over-period metric is the change of the sum against the period before, in percent.
    """

    name: str
    domain: str
    kind: str
    num: str | None = None
    den: str | None = None
    per: str | None = None
    where: str = "true"
    q: float | None = None
    digits: int | None = None
    top: int = 0
    dimensions: Sequence[str] = ()
    grains: Sequence[str] = GRAINS
    thresholds: Mapping[str, float] = field(default_factory=dict)
    tags: Sequence[str] = ()


_DAY, _HOUR = "to_date(started)", "date_trunc('hour', started)"
_MINUTES = "floor(unix_timestamp(ended) / 60) - floor(unix_timestamp(started) / 60)"
_TIP_RATE = "cast(tip as double) / cast(fare as double)"

# Thresholds. Eighteen metrics over rows with started, ended, places, distance, fare, tip, total, payment.
_ALL = (
    Metric("trips_per_day", "volume", "average", "1", per=_DAY, dimensions=("from_r_name", "vendor", "payment"), grains=("day", "month"),
           thresholds={"warning_below": 5000, "critical_below": 1000}, tags=("executive",)),
    Metric("trips_per_hour", "volume", "average", "1", per=_HOUR, dimensions=("from_r_name", "vendor"), grains=("day", "week"),
           thresholds={"warning_below": 200, "critical_below": 50}),
    Metric("avg_party", "volume", "average", "line_no", where="line_no > 0", dimensions=("from_r_name", "vendor"),
           thresholds={"warning_below": 1.0, "critical_below": 0.5}),
    Metric("total_revenue", "revenue", "sum", "total", dimensions=("from_r_name", "vendor", "payment"),
           thresholds={"warning_below": 50000, "critical_below": 10000}, tags=("executive",)),
    Metric("avg_fare", "revenue", "average", "fare", where="fare > 0", dimensions=("from_r_name", "vendor", "payment"),
           thresholds={"warning_below": 8.0, "critical_below": 5.0}, tags=("executive",)),
    Metric("avg_tip_rate", "revenue", "average", _TIP_RATE, where="fare > 0 and tip >= 0", digits=9, dimensions=("from_r_name", "payment"),
           thresholds={"warning_below": 0.10, "critical_below": 0.05}),
    Metric("revenue_per_mile", "revenue", "ratio", "total", den="distance", where="distance > 0", dimensions=("from_r_name", "vendor"),
           thresholds={"warning_below": 3.0, "critical_below": 2.0}),
    Metric("avg_distance", "trip", "average", "distance", where="distance > 0", dimensions=("from_r_name", "vendor", "payment"),
           thresholds={"warning_below": 1.0, "critical_below": 0.5}, tags=("executive",)),
    Metric("avg_duration", "trip", "average", _MINUTES, where="ended > started", dimensions=("from_r_name", "vendor"),
           thresholds={"warning_above": 60, "critical_above": 120}),
    Metric("p95_duration", "trip", "percentile", _MINUTES, where=f"ended > started and {_MINUTES} > 0", q=0.95,
           dimensions=("from_r_name", "vendor"), grains=("day", "week"), thresholds={"warning_above": 60, "critical_above": 90}),
    Metric("short_rate", "trip", "ratio", "int(distance < 5)", den="1", where="distance >= 0", dimensions=("from_r_name", "vendor")),
    Metric("trips", "geographic", "count", "1", dimensions=("vendor", "payment"), tags=("executive",)),
    Metric("active_origins", "geographic", "count", per="from_nation", dimensions=("vendor",)),
    Metric("cross_place_rate", "geographic", "ratio", "int(from_nation <> to_nation)", den="1", dimensions=("vendor",)),
    Metric("urgent_rate", "payment", "ratio", "int(payment = '1-URGENT')", den="1", dimensions=("from_r_name", "vendor")),
    Metric("avg_tip_urgent", "payment", "average", "tip", where="payment = '1-URGENT'", dimensions=("from_r_name", "vendor"),
           thresholds={"warning_below": 1.5, "critical_below": 0.5}),
    Metric("top_origins", "geographic", "ranked", "1", per="from_nation", top=5, dimensions=("from_r_name",)),
    Metric("trips_change", "volume", "period_over_period", "1", dimensions=("from_r_name", "vendor"), grains=("week", "month")),
)
REGISTRY = {m.name: m for m in _ALL}
#: Metrics with one value over all rows; ranked ones have a row per place, changes need a period.
OVERALL = [m.name for m in _ALL if m.kind not in ("ranked", "period_over_period")]


def by_tag(tag: str) -> list[str]:
    return [m.name for m in REGISTRY.values() if tag in m.tags]


def _period(grain: str | None) -> list[Column]:
    if grain is None:
        return []
    day = F.to_date("started")
    return [(day if grain == "day" else F.trunc(day, grain)).alias("period")]


def _num(m: Metric) -> Column:
    return F.expr(f"case when {m.where} then {m.num} end")


def _finish(m: Metric, num: Column, den: Column | None) -> Column:
    if m.kind == "sum":
        return F.round(num, 2).cast("double")
    if den is None:
        return num.cast("double")
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if m.digits is None else F.round(out, m.digits)


def _plain(m: Metric) -> Column:
    """A metric without distinct values, over rows."""
    if m.den is not None:
        den = F.sum(F.expr(f"case when {m.where} then {m.den} end"))
    else:
        den = F.count(_num(m)) if m.kind == "average" else None
    return _finish(m, F.sum(_num(m)), den).alias(m.name)


def _keyed(df: DataFrame, chosen: Sequence[Metric], groups: Sequence[Column | str], keys: Sequence[str]) -> DataFrame:
    """Metrics with distinct values: group by the values, then count and sum the groups."""
    names = {per: f"_k{i}" for i, per in enumerate(sorted({m.per for m in chosen}))}
    sums = [F.sum(_num(m)).alias(f"{m.name}__num") for m in chosen if m.num]
    fine = df.groupBy(*groups, *[F.expr(p).alias(k) for p, k in names.items()]).agg(*(sums or [F.count(F.lit(1)).alias("_rows")]))
    out = []
    for m in chosen:
        values = F.count_distinct(names[m.per])
        out.append((_finish(m, F.sum(f"{m.name}__num"), values) if m.num else values.cast("double")).alias(m.name))
    return fine.groupBy(*keys).agg(*out)


def metrics(df: DataFrame, names: Sequence[str], dims: Sequence[str] = (), grain: str | None = None) -> DataFrame:
    """Several metrics by the same dimensions and grain, one column each (percentiles aside)."""
    chosen = [REGISTRY[n] for n in names]
    for m in chosen:
        unknown = set(dims) - set(m.dimensions)
        if unknown or (grain and grain not in m.grains):
            raise ValueError(f"{m.name} is not defined for {sorted(unknown) or grain}")
    keys = (["period"] if grain else []) + list(dims)
    groups = [*_period(grain), *dims]
    plain, keyed = [m for m in chosen if not m.per], [m for m in chosen if m.per]
    parts = []
    if plain:
        parts.append(df.groupBy(*groups).agg(*[_plain(m) for m in plain]))
    if keyed:
        parts.append(_keyed(df, keyed, groups, keys))
    if len(parts) == 1:
        return parts[0]
    a, b = parts[0], parts[1].withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True))
    return a.join(b if keys else F.broadcast(b), same).select(*keys, *names)


def metric(df: DataFrame, name: str, dims: Sequence[str] = (), grain: str | None = None) -> DataFrame:
    """One metric by dimensions and time grain, as column ``value``."""
    m = REGISTRY[name]
    if m.kind == "ranked":
        return _ranked(df, m, dims, grain)
    if m.kind == "period_over_period":
        return _change(df, m, dims, grain)
    if m.kind != "percentile":
        return metrics(df, [name], dims, grain).withColumnRenamed(name, "value")
    rows = df.filter(m.where).select(*_period(grain), *dims, F.expr(m.num).alias("_v"))
    keys = (["period"] if grain else []) + list(dims)
    return quantiles(rows, keys, "_v", [m.q]).drop("q").withColumn("value", F.round("value", 6))


def _checked_groups(m: Metric, dims: Sequence[str], grain: str | None) -> tuple[list[Column | str], list[str]]:
    unknown = set(dims) - set(m.dimensions)
    if unknown or (grain and grain not in m.grains):
        raise ValueError(f"{m.name} is not defined for {sorted(unknown) or grain}")
    return [*_period(grain), *dims], (["period"] if grain else []) + list(dims)


def _ranked(df: DataFrame, m: Metric, dims: Sequence[str], grain: str | None) -> DataFrame:
    """``item, value, place`` of the ``top`` items of each group."""
    groups, keys = _checked_groups(m, dims, grain)
    counted = df.groupBy(*groups, F.expr(m.per).alias("item")).agg(F.sum(_num(m)).cast("double").alias("value"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))
    return counted.withColumn("place", place).filter(F.col("place") <= m.top)


def _change(df: DataFrame, m: Metric, dims: Sequence[str], grain: str | None) -> DataFrame:
    """``value``: percent change of the sum against the period before, null for the first."""
    if grain is None:
        raise ValueError(f"{m.name} needs a grain")
    groups, keys = _checked_groups(m, dims, grain)
    series = df.groupBy(*groups).agg(F.sum(_num(m)).alias("_v"))
    return growth(series, list(dims), ["period"], "_v").select(*keys, F.col("growth_pct").alias("value"))


def metric_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Many overall metrics, as (metric, value). The rows are computed once, with the columns in use only."""
    texts = " ".join(str(x) for n in names for m in [REGISTRY[n]] for x in (m.num, m.den, m.per, m.where))
    df = materialise(df.select(*[c for c in df.columns if re.search(rf"\b{c}\b", texts)]), "metric-rows")
    simple = [n for n in names if REGISTRY[n].kind != "percentile"]
    lines = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in simple]
    out = metrics(df, simple).select(F.inline(F.array(*lines)))
    for n in names:
        if n not in simple:
            out = out.unionByName(metric(df, n).select(F.lit(n).alias("metric"), "value"))
    return out


def metric_status(values: DataFrame) -> DataFrame:
    """Traffic light per metric: critical bounds first, then warning bounds, else green."""
    status = F.lit("green")
    for m in REGISTRY.values():
        t = m.thresholds
        v = F.col("value")
        red = (v < t["critical_below"]) if "critical_below" in t else (v > t["critical_above"]) if "critical_above" in t else F.lit(False)
        yellow = (v < t["warning_below"]) if "warning_below" in t else (v > t["warning_above"]) if "warning_above" in t else F.lit(False)
        light = F.when(red, "red").when(yellow, "yellow").otherwise("green")
        status = F.when(F.col("metric") == m.name, light).otherwise(status)
    return values.withColumn("status", status)


def metric_trend(df: DataFrame, name: str, grain: str) -> DataFrame:
    """Value per period with the change against the period before."""
    series = metric(df, name, (), grain)
    out = growth(series, [], ["period"], "value")
    arrow = F.when(F.col("growth_pct") > 0, "up").when(F.col("growth_pct") < 0, "down").otherwise("flat")
    return out.withColumn("trend", arrow).drop("next_value")
