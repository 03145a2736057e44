"""Parquet and CSV scans, partition-pruned reads and SQL views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet from paths or globs; with ``schema`` no footer is opened to infer one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def read_merged(spark: SparkSession, *paths: str) -> DataFrame:
    """Union by name over files whose schemas differ; absent columns are NULL."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None,
    as_strings: bool = False, infer: bool = False,
) -> DataFrame:
    """CSV with header. Give a schema; ``as_strings`` keeps raw text; ``infer`` costs a second scan."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer and not as_strings).csv(path)


def read_partition(spark: SparkSession, path: str, predicate: Column) -> DataFrame:
    """Filter on partition columns: only matching directories are listed and read."""
    return spark.read.parquet(path).filter(predicate)


def stamp(df: DataFrame, batch_id: str, type_tag: str) -> DataFrame:
    """Lineage columns: source file, ingest time, batch and type. Use on a file scan."""
    return df.withColumns(
        {
            "_source_file": F.col("_metadata.file_name"),
            "_ingested_at": F.current_timestamp(),
            "_batch_id": F.lit(batch_id),
            "_type": F.lit(type_tag),
        }
    )


def register_views(frames: Mapping[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def partition_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per partition of a partitioned table."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, by its own file system. Anything else wrong with it shows when it is read."""
    place, files = _place(spark, path)
    return files.exists(place)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly under ``path``; none if it does not exist."""
    place, files = _place(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    """Delete ``path`` and all under it, if it is there."""
    place, files = _place(spark, path)
    files.delete(place, True)


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already."""
    place, files = _place(spark, path)
    return files.createNewFile(place)


def publish(spark: SparkSession, staged: str, place: str) -> None:
    """Put the staged folder in the place of another by renaming it; without a staged folder the place is emptied."""
    delete(spark, place)
    if exists(spark, staged):
        there, files = _place(spark, place)
        files.mkdirs(there.getParent())
        if not files.rename(_place(spark, staged)[0], there):
            raise OSError(f"cannot rename {staged} to {place}")
