"""Sorting, top-k, unions, key differences and seeded samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort(df: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*columns)


def top_k(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    """First ``k`` rows; each task keeps only its own best ``k``. Give a unique tie-break."""
    return df.orderBy(*order).limit(k)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def stack_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column absent from a frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    return stack_by_name([f.withColumn(tag, F.lit(name)) for name, f in frames.items()])


def key_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct non-null keys of ``a`` that ``b`` lacks."""
    left = a.select(column).filter(F.col(column).isNotNull()).distinct()
    return left.join(b.select(column), column, "left_anti")


def sample_n(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """``n`` rows picked by a seeded digest of the key: the same rows on any cluster."""
    place = F.md5(F.concat_ws("~", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    return df.withColumn("_place", place).orderBy("_place", *key).limit(n).drop("_place")
