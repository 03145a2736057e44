"""Equi, role-playing, star, anti, set-difference, outer and interval joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranges import lay_out, running

BROADCAST_LIMIT = 32 * 1024 * 1024
#: Estimated bytes of a partition of :func:`dealt`: about half a million rows of three compressed numbers.
DEALT_BYTES = 1536 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Size the optimiser expects: bytes on disk for file scans, which may be several times more in memory; pessimistic for joins."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT, bound: DataFrame | None = None) -> DataFrame:
    """Broadcast hint, only when the estimated size is within ``limit`` bytes.

    Beyond it the frame is returned as it is, and the join shuffles (with AQE skew handling).
    ``bound`` is a frame ``df`` cannot outgrow (the many side of a lookup); its estimate is used
    where that of ``df`` itself would multiply the sizes of the joined tables.
    """
    return F.broadcast(df) if estimated_bytes(df if bound is None else bound) <= limit else df


def join_on(a: DataFrame, b: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    return a.join(b, [keys] if isinstance(keys, str) else list(keys), how)


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a key in one partition, and more partitions the larger the table, by the optimiser's estimate.

    Aggregates by nearly unique keys, and their join, then need no further shuffle and hold about the same number of keys
    a task at any size; behind a scan they would hold a file split's keys, behind a fixed number of partitions a share of all.
    Rows of a hot key stream through one task, which holds one entry for them.
    """
    return df.repartition(max(1, -(-estimated_bytes(df) // DEALT_BYTES)), *keys)


def join_agg(fact: DataFrame, dim: DataFrame, on: Column, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return fact.join(dim, on).groupBy(*by).agg(*aggs)


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left join; attributes of unmatched rows take their default."""
    out = df.join(dim, list(on), "left")
    types = dict(dim.dtypes)
    return out.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in defaults.items()}
    )


def enrich_roles(fact: DataFrame, dim: DataFrame, key: str, roles: Mapping[str, str], how: str = "left") -> DataFrame:
    """Join one dimension once per role; its attributes get the role as prefix."""
    out = fact
    for role, fact_key in roles.items():
        side = dim.select(*[F.col(c).alias(f"{role}_{c}") for c in dim.columns])
        out = out.join(small(side), F.col(fact_key) == F.col(f"{role}_{key}"), how).drop(f"{role}_{key}")
    return out


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left join to each ``(dim, fact key, dim key)``; small dimensions are broadcast."""
    out = fact
    for dim, fact_key, dim_key in dims:
        out = out.join(small(dim), F.col(fact_key) == F.col(dim_key), "left").drop(dim_key)
    return out


def join_any_key(fact: DataFrame, dim: DataFrame, roles: Mapping[str, str], dim_key: str) -> DataFrame:
    """Rows of ``fact`` meet ``dim`` through any of several keys, once each.

    An OR condition would be a nested loop; exploding the distinct keys makes it an equi join. The
    flag column ``via_<role>`` says through which key the row matched.
    """
    keys = F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in roles.values()])))
    flags = {f"via_{role}": F.col(c).eqNullSafe(F.col(dim_key)) for role, c in roles.items()}
    return (
        fact.withColumn("_key", F.explode(keys))
        .join(dim, F.col("_key") == F.col(dim_key))
        .drop("_key")
        .withColumns(flags)
    )


def unused_dims(dim: DataFrame, fact: DataFrame, on: str) -> DataFrame:
    """Dimension rows no fact row refers to."""
    return dim.join(fact.select(on), on, "left_anti")


def not_in(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Rows whose key is absent from ``right``; NULLs in ``right`` do not empty the result."""
    return left.join(right.select(column).filter(F.col(column).isNotNull()), column, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows with a non-null key that has no parent."""
    return child.filter(F.col(child_key).isNotNull()).join(
        parent.select(parent_key), F.col(child_key) == F.col(parent_key), "left_anti"
    )


def not_seen(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.join(old.select(*keys), list(keys), "left_anti")


def seen(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.join(old.select(*keys), list(keys), "left_semi")


def by_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on keys, null keys equal to null keys."""
    other = right.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return left.join(small(other), same, how)


def above_average(df: DataFrame, value: str) -> DataFrame:
    """Rows above the mean of ``value`` over all rows; the one-row mean is broadcast."""
    mean = df.agg(
        F.try_divide(F.sum(value).cast("double"), F.count(value)).alias("overall_mean")
    )
    return df.crossJoin(F.broadcast(mean)).filter(F.col(value) > F.col("overall_mean"))


def full_merge(a: DataFrame, b: DataFrame, keys: Sequence[str], zeros: Sequence[str]) -> DataFrame:
    """Full outer join of two aggregates; measures absent on one side are 0."""
    return a.join(b, list(keys), "full_outer").fillna(0, subset=list(zeros))


def sum_sides(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join of two aggregates on ``key``, adding the columns they share."""
    right = b.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns])
    both = a.join(right, key, "left")
    zero = F.lit(0)
    return both.select(
        key,
        *[(F.coalesce(F.col(c), zero) + F.coalesce(F.col(f"_r_{c}"), zero)).alias(c) for c in columns],
    )


def join_daily(fact: DataFrame, series: DataFrame, ts: str, day: str = "day", how: str = "inner") -> DataFrame:
    """Attach a daily series to rows by calendar day."""
    return fact.withColumn(day, F.to_date(ts)).join(series, day, how)


def as_of_version(fact: DataFrame, dim: DataFrame, key: str, ts: str, how: str = "left") -> DataFrame:
    """The dimension version valid on the row's day (``valid_from``/``valid_to`` inclusive).

    The equality on ``key`` makes it a hash or sort-merge join; the interval is a residual filter.
    """
    versions = dim.withColumnRenamed(key, "_dim_key")
    day = F.to_date(F.col(ts))
    on = (F.col(key) == F.col("_dim_key")) & day.between(F.col("valid_from"), F.col("valid_to"))
    return fact.join(versions, on, how).drop("_dim_key")


def as_of_running(fact: DataFrame, dim: DataFrame, key: str, ts: str, how: str = "left") -> DataFrame:
    """:func:`as_of_version` for long histories and hot keys, without pairing a row with every version of its key.

    Rows and versions are laid out in one order by key and day over ranges, and the version that began last is
    carried forward to the rows after it; it holds if the day is not past its end. A row meets one version
    at most: where versions overlap, the one that began last. A null key meets none.
    """
    versions = F.struct("valid_from", *[c for c in dim.columns if c not in (key, "valid_from")])
    empty_fact, empty_version = fact.select(F.struct("*").alias("f")).schema["f"].dataType, dim.select(versions.alias("v")).schema["v"].dataType
    rows = fact.select(F.col(key).alias("_key"), F.to_date(F.col(ts)).alias("_day"), F.lit(1).alias("_row"), F.struct("*").alias("_fact"),
                       F.lit(None).cast(empty_version).alias("_version"))
    starts = dim.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col("valid_from").alias("_day"), F.lit(0).alias("_row"), F.lit(None).cast(empty_fact).alias("_fact"), versions.alias("_version"))
    laid = lay_out(rows.unionAll(starts), ["_key"], ["_day", "_row"])
    met = running(laid, ["_key"], ["_day", "_row"], {"_last": ("max", F.col("_version"))}).filter("_row = 1")
    holds = F.col("_key").isNotNull() & (F.col("_day") <= F.col("_last.valid_to"))
    met = met.withColumn("_last", F.when(holds, F.col("_last")))
    out = met if how == "left" else met.filter(F.col("_last").isNotNull())
    return out.select("_fact.*", *[F.col(f"_last.{c}").alias(c) for c in dim.columns if c != key])
