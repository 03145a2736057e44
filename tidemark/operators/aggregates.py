"""Grouped summaries. All of them aggregate on the map side before the shuffle."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tidemark.functions.amounts import mean, mean_ratio, ratio
from tidemark.operators.joins import small
from tidemark.scratch import materialise


def summarise(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def distinct_counts(
    df: DataFrame, by: Sequence[str], columns: Mapping[str, Column], approx: bool = False
) -> DataFrame:
    """Distinct values per group; ``approx`` uses a fixed-size sketch for profiles.

    Several exact counts in one aggregate would copy every row once for each. Here each is counted on its own
    narrow scan, and the counts meet in one small aggregate.
    """
    if approx or len(columns) == 1:
        count = F.approx_count_distinct if approx else F.count_distinct
        return summarise(df, by, {n: count(c) for n, c in columns.items()})
    parts = []
    for name, c in columns.items():
        others = [F.lit(None).cast("bigint").alias(n) if n != name else F.col(n) for n in columns]
        parts.append(df.groupBy(*by).agg(F.count_distinct(c).alias(name)).select(*by, *others))
    return reduce(DataFrame.unionAll, parts).groupBy(*by).agg(*[F.max(n).alias(n) for n in columns])


def share(df: DataFrame, by: Sequence[str], condition: Column) -> DataFrame:
    """Rows, rows meeting the condition, and their fraction."""
    hits = F.count_if(condition)
    return summarise(
        df, by, {"rows": F.count(F.lit(1)), "hits": hits, "share": hits / F.count(F.lit(1))}
    )


def ratio_of_sums(df: DataFrame, by: Sequence[str], num: str, den: str) -> DataFrame:
    return summarise(df, by, {"ratio": ratio(F.sum(num), F.sum(den))})


def mean_of_ratios(df: DataFrame, by: Sequence[str], num: str, den: str) -> DataFrame:
    """Mean over rows of ``num / den``; rows with a zero denominator do not count."""
    each = F.when(F.col(den) != 0, F.col(num).cast("double") / F.col(den).cast("double"))
    return summarise(df, by, {"ratio": mean_ratio(each)})


def per_active_day(df: DataFrame, by: Sequence[str], ts: str, integer: bool = False) -> DataFrame:
    """Rows per day on which the group has any row; ``integer`` truncates."""
    rows, days = F.count(F.lit(1)), F.count_distinct(F.to_date(ts))
    per_day = F.floor(rows / days).cast("bigint") if integer else rows / days
    return summarise(df, by, {"rows": rows, "active_days": days, "per_day": per_day})


def two_level(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str, weighted: bool) -> DataFrame:
    """Mean of ``value`` per outer group, through inner groups.

    ``weighted`` weighs each inner group by its rows; otherwise every inner mean counts once.
    """
    fine = df.groupBy(*inner).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n"), mean(value).alias("_mean")
    )
    if weighted:
        out = F.try_divide(F.sum("_sum").cast("double"), F.sum("_n"))
    else:
        out = mean(F.col("_mean").cast("decimal(24,8)"))
    return fine.groupBy(*outer).agg(F.count(F.lit(1)).alias("groups"), out.alias("mean_value"))


#: First bins hold values of one sign whose sizes (plus one) differ by less than a factor 2 ** (1 / this).
BINS_A_DOUBLING = 16
#: Bins of a later round, and rows that are few enough to be ranked by value.
BINS, FEW_ROWS = 1024, 200_000


def _first_bin(x: Column) -> Column:
    """A whole number that never falls as ``x`` grows; NaN is greatest, as in Spark's order."""
    size = F.floor(F.log1p(F.abs(x)) * (BINS_A_DOUBLING / math.log(2)))
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).when(x < 0, -size - 1).otherwise(size)


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Inner join on equal keys (null equals null) and ``more``, which is broadcast where ``right`` is small."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(and_, [*[F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], *more], F.lit(True))
    return left.join(small(other), on).drop(*[f"_r_{k}" for k in keys])


def quantiles(df: DataFrame, by: Sequence[str], column: str, qs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles, one row per group and ``q``, by selection.

    A histogram (an aggregate by group and bin, combined on the map side) says which bins hold the wanted
    ranks. Only rows of these bins are looked at again: in finer bins between the bin's least and greatest
    value while there are many, else counted by value. A bin of one value needs no further look. So no
    exchange carries all values, and none gathers the rows of a group; windows run over the bins of
    a group, or over few values. Every round splits every bin left, so the rounds end.
    """
    by = list(by)
    rows = df.select(*by, F.col(column).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    bins, rows = ["_b0"], rows.withColumn("_b0", _first_bin(F.col("_x")))
    counts = [F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    hist = materialise(rows.groupBy(*by, "_b0").agg(*counts), "histogram")
    points = F.explode(F.array(*[F.lit(float(q)) for q in qs]))
    want = hist.groupBy(*by).agg(F.sum("_n").alias("_size")).withColumn("q", points).withColumn("_pos", F.col("q") * (F.col("_size") - 1))
    low = F.floor("_pos")
    both = F.array(F.struct(F.lit(False).alias("_up"), low.alias("_rank")), F.struct(F.lit(True).alias("_up"), F.ceil("_pos").alias("_rank")))
    ranks = want.select(*by, "q", (F.col("_pos") - low).alias("_w"), F.inline(both))

    def located(ranks: DataFrame, hist: DataFrame, start: Column, keys: Sequence[str], order: str) -> DataFrame:
        """The bin that holds each rank. ``start`` rows lie before the bins of ``keys``."""
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        placed = hist.withColumn("_start", start + upto - F.col("_n"))
        inside = (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_n"))
        return materialise(_meet(ranks, placed, keys, inside), "ranks")

    found, done = located(ranks, hist, F.lit(0), by, "_b0"), []
    while True:
        done.append(found.filter(~(F.col("_lo") < F.col("_hi"))).select(*by, "q", "_w", "_up", F.col("_lo").alias("_value")))
        open_ = found.filter(F.col("_lo") < F.col("_hi"))
        wanted = open_.select(*by, *bins, "_start", "_lo", "_hi", "_n").distinct()
        left = wanted.agg(F.sum("_n")).first()[0] or 0
        if not left:
            break
        rows = _meet(rows, wanted.withColumnsRenamed({c: f"_of{c}" for c in ("_start", "_lo", "_hi", "_n")}), [*by, *bins])
        ranks = open_.select(*by, *bins, "q", "_w", "_up", "_rank")
        if left <= FEW_ROWS:
            inner = F.col("_x")
        else:
            share = (F.col("_x") - F.col("_of_lo")) / (F.col("_of_hi") - F.col("_of_lo"))
            inner = F.when(F.col("_x") >= F.col("_of_hi"), BINS - 1).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        level = f"_b{len(bins)}"
        finer = rows.withColumn(level, inner)
        hist = finer.groupBy(*by, *bins, "_of_start", level).agg(*counts)
        found = located(ranks, hist, F.col("_of_start"), [*by, *bins], level)
        rows, bins = finer.drop("_of_start", "_of_lo", "_of_hi", "_of_n"), [*bins, level]
    values = reduce(DataFrame.unionByName, done)
    ends = [F.max(F.when(F.col("_up") == up, F.col("_value"))).alias(n) for up, n in ((False, "_at"), (True, "_next"))]
    return values.groupBy(*by, "q").agg(*ends, F.first("_w").alias("_w")).select(
        *by, "q", (F.col("_at") + (F.col("_next") - F.col("_at")) * F.col("_w")).alias("value"))


def approx_quantiles(df: DataFrame, by: Sequence[str], column: str, qs: Sequence[float], accuracy: int = 10000) -> DataFrame:
    """Quantile sketch: fixed memory per group, one pass."""
    return summarise(
        df, by, {"quantiles": F.percentile_approx(column, [float(q) for q in qs], accuracy)}
    )


def most_common(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Mode per group; the smallest value wins a tie."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("neg"), F.col(column).alias("item")))
    return counted.groupBy(*by).agg(best.alias("_best")).select(
        *by, F.col("_best.item").alias("most_common"), (-F.col("_best.neg")).alias("occurrences")
    )


def correlations(df: DataFrame, xs: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, in one aggregate."""
    pairs = [(x, y) for x in xs for y in ys]
    row = df.agg(*[F.corr(x, y).alias(f"_{i}") for i, (x, y) in enumerate(pairs)])
    items = ", ".join(f"'{x}', '{y}', _{i}" for i, (x, y) in enumerate(pairs))
    return row.selectExpr(f"stack({len(pairs)}, {items}) as (x, y, correlation)")


def pivot(
    df: DataFrame, rows: Sequence[str], column: str, values: Sequence[object], agg: Column, other: str | None = None
) -> DataFrame:
    """Known values become columns, so no job is needed to find them; absent cells are 0.

    Rows with any other value, or none, gather in the column ``other`` where one is named; without it
    ``values`` must cover the domain.
    """
    names = [str(v) for v in values]
    if other is not None:
        shown = F.when(F.col(column).isin(*values), F.col(column).cast("string")).otherwise(other)
        df, names = df.withColumn(column, shown), [*names, other]
        values = names
    return df.groupBy(*rows).pivot(column, list(values)).agg(agg).fillna(0)


#: A measure of a cube: a column to sum, or (sum|count|mean|min|max, column).
Measure = Column | tuple[str, Column]
_FINE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_COARSE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _kinds(measures: Mapping[str, Measure]) -> list[tuple[str, str, Column]]:
    return [(n, *(m if isinstance(m, tuple) else ("sum", m))) for n, m in measures.items()]


def _finest(df: DataFrame, dims: Sequence[str], measures: Mapping[str, Measure]) -> DataFrame:
    out = []
    for name, kind, c in _kinds(measures):
        if kind == "mean":
            out += [F.sum(c).alias(f"{name}__sum"), F.count(c).alias(f"{name}__count")]
        else:
            out.append(_FINE[kind](c).alias(name))
    return df.groupBy(*dims).agg(*out)


def _levels(grouped: GroupedData, measures: Mapping[str, Measure]) -> DataFrame:
    out = []
    for name, kind, _ in _kinds(measures):
        if kind == "mean":
            out.append(F.try_divide(F.sum(f"{name}__sum").cast("double"), F.sum(f"{name}__count")).alias(name))
        else:
            out.append(_COARSE[kind](name).alias(name))
    return grouped.agg(F.grouping_id().cast("int").alias("level"), *out)


def rollup(df: DataFrame, dims: Sequence[str], measures: Mapping[str, Measure]) -> DataFrame:
    """Subtotals from the finest level up; ``level`` is the grouping bitmap.

    Sums, counts, minima and maxima combine, and a mean is a sum and a count until the end, so rows are
    first reduced to the finest level and only those groups, not the rows, are repeated for every level.
    """
    return _levels(_finest(df, dims, measures).rollup(*dims), measures)


def cube(df: DataFrame, dims: Sequence[str], measures: Mapping[str, Measure]) -> DataFrame:
    """Subtotals for every subset of the dimensions; the finest level is reduced first."""
    return _levels(_finest(df, dims, measures).cube(*dims), measures)


def slice_cube(cubed: DataFrame, fixed: Mapping[str, object]) -> DataFrame:
    """Slice or dice: fix one value, or a list of values, per dimension."""
    out = cubed
    for c, v in fixed.items():
        out = out.filter(F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == F.lit(v))
    return out


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """Rows per bin of fixed width, with each bin's share of all rows (bins, not rows, are ranked)."""
    low = F.floor(F.col(column) / F.lit(width)) * F.lit(width)
    bins = df.filter(F.col(column).isNotNull()).groupBy(low.cast("double").alias("bin")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return bins.crossJoin(F.broadcast(bins.agg(F.sum("rows").alias("_all")))).select("bin", "rows", (F.col("rows") / F.col("_all")).alias("share"))


def min_support(df: DataFrame, by: Sequence[str], n: int, aggs: Mapping[str, Column] | None = None) -> DataFrame:
    """Groups with at least ``n`` rows."""
    return summarise(df, by, {"rows": F.count(F.lit(1)), **(aggs or {})}).filter(F.col("rows") >= n)


def describe_nulls(df: DataFrame) -> DataFrame:
    """Rows, non-null and NULL count of every column in one pass."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in cols])
    items = ", ".join(f"'{c}', _rows, `{c}`, _rows - `{c}`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {items}) as (column_name, total, present, missing)")


def distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()
