"""Column profiles: one wide aggregate, plus one narrow aggregate per question that needs a shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.scratch import materialise


def profile(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """One row per column: nulls, distinct values, range, mean, deviation, negatives.

    Distinct counts are sketches unless ``exact_distinct``; exact ones cost a narrow scan and a shuffle of the
    distinct values per column.
    """
    def stats(field: T.StructField) -> list[Column]:
        c = F.col(field.name)
        numeric = isinstance(field.dataType, T.NumericType)
        number = c.cast("double") if numeric else F.lit(None).cast("double")
        return [
            F.count(c).alias(f"{field.name}__n"),
            F.approx_count_distinct(c).alias(f"{field.name}__d"),
            F.min(c).cast("string").alias(f"{field.name}__lo"),
            F.max(c).cast("string").alias(f"{field.name}__hi"),
            F.avg(number).alias(f"{field.name}__mean"),
            F.stddev_samp(number).alias(f"{field.name}__std"),
            F.count_if(number < 0).alias(f"{field.name}__neg"),
        ]

    names = df.columns
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[s for f in df.schema.fields for s in stats(f)])
    if exact_distinct:
        row = row.drop(*[f"{c}__d" for c in names])
        for c in names:  # one row each, counted side by side; a scan reads its own column only
            row = row.crossJoin(F.broadcast(df.agg(F.count_distinct(c).alias(f"{c}__d"))))
    lines = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("__rows").alias("total"),
            (F.col("__rows") - F.col(f"{c}__n")).alias("nulls"),
            F.when(F.col("__rows") > 0, (F.col("__rows") - F.col(f"{c}__n")) / F.col("__rows") * 100)
            .otherwise(0.0).alias("null_pct"),
            F.col(f"{c}__d").alias("distinct_values"),
            F.col(f"{c}__lo").alias("min_value"),
            F.col(f"{c}__hi").alias("max_value"),
            F.col(f"{c}__mean").alias("mean_value"),
            F.col(f"{c}__std").alias("std_value"),
            F.col(f"{c}__neg").alias("negatives"),
        )
        for c in names
    ]
    return row.select(F.inline(F.array(*lines)))


#: Hash buckets of a column's values, and the fullest of them whose values are counted.
BUCKETS, FULLEST = 4096, 64


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """Most frequent values of each column, as text; ties by value.

    One scan counts the rows of every column's hash buckets; a second counts the values in the fullest
    buckets only. A value in another bucket is no more frequent than its bucket is full, so where the last
    of the ``k`` values found is more frequent than that, they are the most frequent ones. Columns without
    such values, keys for instance, are counted whole.
    """
    def bucket(c: str) -> Column:
        exact = (T.IntegralType, T.StringType, T.DecimalType, T.DateType, T.BooleanType)
        value = F.col(c) if isinstance(df.schema[c].dataType, exact) else F.col(c).cast("string")
        return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")

    cells = F.array(*[F.struct(F.lit(i).alias("c"), bucket(c).alias("b")) for i, c in enumerate(columns)])
    full: dict[int, list] = {i: [] for i in range(len(columns))}
    for r in df.select(F.inline(cells)).groupBy("c", "b").agg(F.count(F.lit(1)).alias("n")).collect():  # at most BUCKETS a column
        full[r["c"]].append((r["n"], r["b"]))
    chosen, bound = {}, {}
    for i, found in full.items():
        found.sort(reverse=True)
        most = max(FULLEST, 4 * k)
        chosen[i], bound[i] = [b for _, b in found[:most]], found[most][0] if len(found) > most else 0
    wanted = F.array(*[
        F.when(bucket(c).isin(chosen[i]), F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("value"))) for i, c in enumerate(columns)
    ])
    counted = materialise(df.select(F.explode(F.array_compact(wanted)).alias("x")).groupBy("x.c", "x.value").agg(F.count(F.lit(1)).alias("n")), "top-values")
    order = [F.col("n").desc(), "value"]

    def one(i: int, c: str) -> DataFrame:
        best = counted.filter(F.col("c") == i).orderBy(*order).limit(k)
        last = best.agg(F.count(F.lit(1)).alias("found"), F.min("n").alias("n")).first()
        proven = bound[i] == 0 or (last["found"] == k and last["n"] > bound[i])
        if not proven:
            best = df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(*order).limit(k)
        return best.select(F.lit(c).alias("column_name"), "value", F.col("n").alias("occurrences"))

    return reduce(DataFrame.unionAll, [one(i, c) for i, c in enumerate(columns)])


def sample_values(df: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """The ``k`` smallest distinct values of each column, as text."""
    def one(c: str) -> DataFrame:
        few = df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(k)
        return few.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))

    return reduce(DataFrame.unionAll, [one(c) for c in columns])


def duplicate_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows (or equal keys)."""
    groups = df.groupBy(*(keys or df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.sum("_n").alias("rows"), (F.sum("_n") - F.count(F.lit(1))).alias("duplicates")
    )


def domain_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows hit by each named domain rule, with their percent of all rows."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(c).alias(n) for n, c in rules.items()])
    lines = [
        F.struct(
            F.lit(n).alias("rule"), F.col(n).alias("hits"),
            F.when(F.col("_rows") > 0, F.col(n) / F.col("_rows") * 100).otherwise(0.0).alias("pct"),
        )
        for n in rules
    ]
    return row.select(F.inline(F.array(*lines)))
