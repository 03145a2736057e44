"""Sinks: codecs, formats, partitioned, period-wise, clustered and evolving writes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.history import union_evolved
from tidemark.sources.readers import exists, read_merged


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", mode: str = "errorifexists") -> None:
    """Codec: none, snappy, gzip or zstd."""
    df.write.mode(mode).option("compression", codec).parquet(path)


def write_as(df: DataFrame, path: str, fmt: str) -> None:
    """CSV with header, or JSON lines."""
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    writer.format(fmt).save(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace the whole table, so a rerun leaves the same result."""
    df.write.mode("overwrite").parquet(path)


def write_partitioned(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Directory per key value.

    The rebalance hint gathers rows by key, and adaptive execution then splits a value that holds much
    of the table over several writers and merges small ones, towards the session's advisory size.
    """
    _gathered(df, columns).write.mode("overwrite").partitionBy(*columns).parquet(path)


def write_period(df: DataFrame, path: str, period_column: str) -> None:
    """Replace only the periods present in ``df``; others stay, so backfills are safe."""
    (
        _gathered(df, [period_column]).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(period_column)
        .parquet(path)
    )


def _gathered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.hint("rebalance", *[F.col(c) for c in columns])


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], n_files: int) -> None:
    """Range-partition and sort by the columns: few files, narrow min/max statistics in each."""
    ranged = df.repartitionByRange(n_files, *columns).sortWithinPartitions(*columns)
    ranged.write.mode("overwrite").parquet(path)


def write_interleaved(df: DataFrame, path: str, columns: Sequence[str], n_files: int, bits: int = 8) -> None:
    """Cluster by several columns at once: rows in the order of interleaved bits of the columns' ranks.

    A column's rank is the number of its quantile bounds (``2 ** bits - 1``, estimated in one pass over all
    columns) at or below the value, so skewed columns use all ranks; nulls come first. A file holds a
    narrow range of every column, where a plain sort narrows only the first.
    """
    shares = [(i + 1) / (1 << bits) for i in range((1 << bits) - 1)]
    numbers = {c: _number(df, c) for c in columns}
    found = df.agg(*[F.percentile_approx(x, shares, 10 << bits).alias(c) for c, x in numbers.items()]).first()
    out, names = df, []
    for c, x in numbers.items():
        rank, value = f"_rank_{c}", f"_value_{c}"
        bounds = F.lit(found[c] or []).cast("array<double>")
        out = out.withColumns({rank: F.lit(0), value: x})
        for step in reversed([1 << i for i in range(bits)] if found[c] else []):  # bisection, one comparison a bit
            out = out.withColumn(rank, F.col(rank) + F.when(F.element_at(bounds, F.col(rank) + step) <= F.col(value), step).otherwise(0))
        names += [rank, value]
    spread = [
        F.shiftleft(F.shiftright(F.col(f"_rank_{c}"), bit).bitwiseAND(1).cast("bigint"), bit * len(columns) + k)
        for k, c in enumerate(columns) for bit in range(bits)
    ]
    placed = out.withColumn("_place", reduce(lambda a, b: a.bitwiseOR(b), spread)).drop(*names)
    placed.repartitionByRange(n_files, "_place").sortWithinPartitions("_place").drop("_place").write.mode("overwrite").parquet(path)


def _number(df: DataFrame, column: str) -> Column:
    """The column as a number in the same order: text by its first seven bytes, times by their microseconds."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.substring(F.hex(c), 1, 14), 14, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double") if isinstance(kind, T.DateType) else c.cast("double")


def compact(df: DataFrame, path: str, n_files: int) -> None:
    """Fewer, larger files. A coalesce would also leave the reading to ``n_files`` tasks, so rows are dealt anew."""
    df.repartition(n_files).write.mode("overwrite").parquet(path)


def append_evolving(df: DataFrame, path: str) -> DataFrame:
    """Append rows that may bring new columns; the table is read with the merged schema."""
    df.write.mode("append").parquet(path)
    return read_merged(df.sparkSession, path)


def rewrite_evolved(df: DataFrame, path: str, new_path: str, defaults: dict[str, object]) -> DataFrame:
    """Write old table plus ``df`` to ``new_path``, old rows taking the defaults of new columns.

    Only a missing ``path`` counts as an empty table; one that cannot be read is an error.
    """
    spark = df.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else df.limit(0)
    overwrite(union_evolved(old, df, defaults), new_path)
    return spark.read.parquet(new_path)
