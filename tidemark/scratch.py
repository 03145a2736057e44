"""Shared scratch space: the folder named by ``spark.checkpoint.dir``.

Intermediate tables go there as Parquet, so a lost executor re-reads them instead of recomputing.
Building a plan that uses one runs the job that writes it. Frames stay readable until :func:`clear` or
the end of a :func:`scope`, which delete what this process has written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unique path under the shared scratch folder.

    Only a master of one machine may fall back to its temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = f"{tempfile.gettempdir()}/tidemark-scratch"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to scratch and read it back: one computation, no lineage behind it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables written after the first ``since``; frames that read them end with them."""
    while len(_written) > since:
        place = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside are deleted at the end; use results, or write them, before it."""
    start = len(_written)
    try:
        yield
    finally:
        clear(spark, start)
