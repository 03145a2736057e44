"""Star schema: surrogate keys, date keys and validity filters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_key
from tidemark.functions.times import date_key
from tidemark.operators.windows import sequence_no


def with_row_id(dim: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Dense integer ids in ``order``; works for a dimension of any size."""
    return sequence_no(dim, [], order).withColumnRenamed("seq", name)


def build_fact(df: DataFrame, mapping: Mapping[str, str | Column], dates: Mapping[str, str], validity: Column, key: list[str]) -> DataFrame:
    """Fact rows with a hashed key and YYYYMMDD date keys; the calendar needs no join."""
    cols = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in mapping.items()]
    keys = [date_key(ts).alias(name) for name, ts in dates.items()]
    return df.filter(validity).select(hash_key(key).alias("fact_key"), *keys, *cols)
