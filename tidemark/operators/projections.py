"""Staging, schema enforcement, harmonising and imputation."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def stage(df: DataFrame, columns: Mapping[str, tuple[str, str]], required: Sequence[str] = ()) -> DataFrame:
    """Rename and cast to ``{new: (old, type)}``, then drop rows with NULL in a required column."""
    out = df.select(*[F.col(old).cast(kind).alias(new) for new, (old, kind) in columns.items()])
    return out.filter(reduce(and_, [F.col(c).isNotNull() for c in required])) if required else out


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate)


def enforce(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Fit ``df`` to ``schema``: columns absent from it are dropped, missing ones become NULL.

    Second result has one row per column: how many non-null values did not survive the cast, or only
    as another value (1.7 does not fit a whole number).
    """
    source = dict(df.dtypes)
    want = schema.fields

    def fitted(f: T.StructField) -> Column:
        if f.name not in source:
            return F.lit(None).cast(f.dataType)
        return F.col(f.name).try_cast(f.dataType)

    def survives(f: T.StructField) -> Column:
        """The value cast back, or for text the number it stands for, is what it was."""
        if isinstance(f.dataType, T.IntegralType) and source[f.name] == "string":
            return fitted(f) == F.col(f.name).try_cast("decimal(38,18)")
        if source[f.name] == "string" or isinstance(f.dataType, T.StringType):
            return fitted(f).isNotNull()
        return fitted(f).try_cast(source[f.name]) == F.col(f.name)

    fit = df.select(*[fitted(f).alias(f.name) for f in want])
    lost = df.agg(
        *[
            F.count_if(F.col(f.name).isNotNull() & ~F.coalesce(survives(f), F.lit(False))).alias(f.name)
            if f.name in source
            else F.count(F.lit(1)).alias(f.name)
            for f in want
        ]
    )
    pairs = ", ".join(f"'{f.name}', `{f.name}`" for f in want)
    return fit, lost.selectExpr(f"stack({len(want)}, {pairs}) as (column_name, failures)")


def enforce_or_infer(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, bool]:
    """The fitted frame if every value fits, else the frame as read, which is logged; the flag says which."""
    fit, report = enforce(df, schema)
    failing = {r["column_name"]: r["failures"] for r in report.filter("failures > 0").collect()}  # a row per column
    if failing:
        log.warning("schema not enforced; values that do not fit, by column: %s", failing)
        return df, False
    return fit, True


def harmonise(df: DataFrame, mapping: Mapping[str, str | Column], tag: str | Column, tag_column: str = "source") -> DataFrame:
    """Bring a source to the common layout ``{target: source column or expression}`` and label it.

    ``tag`` may be a column where the rows of several sources come from one scan.
    """
    cols = [(F.col(src) if isinstance(src, str) else src).alias(dst) for dst, src in mapping.items()]
    return df.select(*cols, (F.lit(tag) if isinstance(tag, str) else tag).alias(tag_column))


def impute_median(df: DataFrame, column: str) -> DataFrame:
    """NULLs take the exact median of the non-null values, and stay NULL when there are none."""
    from tidemark.operators.aggregates import quantiles

    mid = quantiles(df, [], column, [0.5]).select(F.col("value").alias("_median"))
    kind = dict(df.dtypes)[column]
    return (
        df.join(F.broadcast(mid), F.lit(True), "left")
        .withColumn(column, F.coalesce(F.col(column), F.col("_median").cast(kind)))
        .drop("_median")
    )
