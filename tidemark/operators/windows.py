"""Ranking and frames over *aggregated* frames.

Operators without ``part`` use one global window. That is for frames whose size is bounded by the
calendar or by a fixed dimension (days, months, nations). For facts use
:mod:`tidemark.operators.ranges`, which spreads one order over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import with_row_number

Order = Sequence[str | Column]


def _w(part: Sequence[str], order: Order):
    return Window.partitionBy(*part).orderBy(*order)


def _avg(c: str, frame) -> Column:
    return F.try_divide(F.sum(c).over(frame).cast("double"), F.count(c).over(frame))


def running_total(df: DataFrame, part: Sequence[str], order: Order, column: str, name: str = "running_total") -> DataFrame:
    frame = _w(part, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(column).over(frame))


def rank_all(df: DataFrame, part: Sequence[str], order: Order, tie_break: Order) -> DataFrame:
    """Rank with gaps, dense rank and unique row number side by side."""
    w = _w(part, order)
    return df.withColumns(
        {
            "rank_gaps": F.rank().over(w),
            "rank_dense": F.dense_rank().over(w),
            "row_num": F.row_number().over(_w(part, [*order, *tie_break])),
        }
    )


def top_n_per(df: DataFrame, part: Sequence[str], order: Order, n: int, ties: bool = True) -> DataFrame:
    """Best ``n`` per group; Spark cuts each task's input with a window group limit first."""
    rank = F.rank() if ties else F.row_number()
    return df.withColumn("place", rank.over(_w(part, order))).filter(F.col("place") <= n)


def arg_max_per(df: DataFrame, part: Sequence[str], value: str, item: str) -> DataFrame:
    """Item with the largest value per group; the smallest item wins a tie. No window needed."""
    best = F.min(F.struct((-F.col(value)).alias("neg"), F.col(item).alias("item")))
    return df.groupBy(*part).agg(best.alias("_best")).select(
        *part, F.col("_best.item").alias(item), (-F.col("_best.neg")).alias(value)
    )


def moving_avg(df: DataFrame, part: Sequence[str], order: Order, column: str, n: int, name: str) -> DataFrame:
    """Mean of this row and the ``n - 1`` before it."""
    return df.withColumn(name, _avg(column, _w(part, order).rowsBetween(1 - n, 0)))


def growth(df: DataFrame, part: Sequence[str], order: Order, column: str, lag: int = 1) -> DataFrame:
    """Earlier and next value, and the change against the earlier one in percent."""
    w = _w(part, order)
    prev = F.lag(column, lag).over(w)
    change = F.try_divide((F.col(column) - prev).cast("double"), prev.cast("double")) * 100
    return df.withColumns(
        {
            "prev_value": prev,
            "growth_pct": F.when(prev != 0, change),
            "next_value": F.lead(column, 1).over(w),
        }
    )


def percent_of(df: DataFrame, part: Sequence[str], column: str, tie_break: str) -> DataFrame:
    """Percent of group, percent of all, and cumulative percent of group (largest first)."""
    group = Window.partitionBy(*part)
    pareto = group.orderBy(F.col(column).desc(), F.col(tie_break)).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum(column).over(group)
    pct = lambda a, b: F.try_divide(a.cast("double"), b.cast("double")) * 100
    return df.withColumns(
        {
            "pct_of_group": pct(F.col(column), whole),
            "pct_of_all": pct(F.col(column), F.sum(column).over(Window.partitionBy())),
            "cumulative_pct": pct(F.sum(column).over(pareto), whole),
        }
    )


def quantile_segments(df: DataFrame, order: Sequence[str], n: int, name: str = "segment") -> DataFrame:
    """NTILE over any number of rows: the row number comes from ranges, the tile from arithmetic."""
    numbered = with_row_number(df, [], order, "_rn")
    size = F.broadcast(df.agg(F.count(F.lit(1)).alias("_size")))
    base, extra = F.expr(f"_size div {n}"), F.expr(f"_size % {n}")
    wide = extra * (base + 1)
    rn = F.col("_rn") - 1
    tile = F.when(rn < wide, F.floor(rn / (base + 1))).otherwise(
        extra + F.floor((rn - wide) / F.greatest(base, F.lit(1)))
    )
    return numbered.crossJoin(size).withColumn(name, (tile + 1).cast("int")).drop("_rn", "_size")


def extremes(df: DataFrame, part: Sequence[str], value: str, item: str) -> DataFrame:
    """Item with the largest and with the smallest value per group, one row per group."""
    high = F.min(F.struct((-F.col(value)).alias("neg"), F.col(item).alias("item")))
    low = F.min(F.struct(F.col(value).alias("val"), F.col(item).alias("item")))
    return df.groupBy(*part).agg(high.alias("_h"), low.alias("_l")).select(
        *part,
        F.col("_h.item").alias(f"peak_{item}"),
        (-F.col("_h.neg")).alias(f"peak_{value}"),
        F.col("_l.item").alias(f"quiet_{item}"),
        F.col("_l.val").alias(f"quiet_{value}"),
    )


def percentile_rank(df: DataFrame, part: Sequence[str], column: str) -> DataFrame:
    return df.withColumn("pct_rank", F.percent_rank().over(_w(part, [column])))


def agg_rank(df: DataFrame, by: Sequence[str | Column], measure: Column, name: str, part: Sequence[str] = ()) -> DataFrame:
    """Aggregate, then rank all groups by the aggregate, in total or within ``part``."""
    return df.groupBy(*by).agg(measure.alias(name)).withColumn(
        "place", F.rank().over(Window.partitionBy(*part).orderBy(F.col(name).desc()))
    )


def sequence_no(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Position of each fact row within its key; a hot key is spread over many tasks."""
    return with_row_number(df, keys, order, "seq")


def volume_bands(
    df: DataFrame, order: str, column: str, n: int = 3, sigma: float = 2.0, pct: float = 50.0,
    include_current: bool = False,
) -> DataFrame:
    """Rolling mean ± ``sigma`` sample deviations, and change against the previous period.

    The baseline is the ``n`` periods *before* the row; a band that contains the row it judges can
    hardly be left (``include_current`` gives that form). At least two periods are needed.
    """
    w = Window.partitionBy().orderBy(order)
    frame = w.rowsBetween(1 - n, 0) if include_current else w.rowsBetween(-n, -1)
    enough = F.count(column).over(frame) >= 2
    prev = F.lag(column).over(w)
    out = df.withColumns(
        {
            "band_mean": F.when(enough, _avg(column, frame)),
            "band_std": F.when(enough, F.stddev_samp(column).over(frame)),
            "prev_value": prev,
            "change_pct": F.when(prev != 0, F.abs(F.col(column) - prev) / prev * 100),
        }
    )
    upper = F.col("band_mean") + sigma * F.col("band_std")
    lower = F.greatest(F.col("band_mean") - sigma * F.col("band_std"), F.lit(0.0))
    outside = F.coalesce((F.col(column) > upper) | (F.col(column) < lower), F.lit(False))
    jump = F.coalesce(F.col("change_pct") > pct, F.lit(False))
    return out.withColumns(
        {
            "band_upper": upper,
            "band_lower": F.when(enough, lower),
            "outside_band": outside,
            "jump": jump,
            "is_anomaly": outside | jump,
        }
    )


def outlier_periods(df: DataFrame, column: str, sigma: float = 2.0) -> DataFrame:
    """Periods further than ``sigma`` deviations from the mean of all periods."""
    stats = df.agg(F.avg(column).alias("overall_mean"), F.stddev_samp(column).alias("overall_std"))
    far = F.abs(F.col(column) - F.col("overall_mean")) > sigma * F.col("overall_std")
    return df.crossJoin(F.broadcast(stats)).filter(far)
