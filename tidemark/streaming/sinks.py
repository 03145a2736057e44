"""Streams into tables, stream-side dedupe and stream–table joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.history import dedupe
from tidemark.operators.joins import small
from tidemark.scratch import scratch_path


def read_stream(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_to_table(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Take everything available, exactly once, into a Parquet table (append)."""
    (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )


def drain(
    stream: DataFrame, mode: str, label: str, each: Callable[[DataFrame], DataFrame] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Run an aggregating stream over what is available and read its result back.

    A micro-batch writes its own directory and overwrites it when retried. ``append`` results are
    all directories together, ``complete`` results the newest one, and ``update`` results the newest
    row of each of ``keys``; ``update`` writes only what changed, so it suits many keys.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")

    def write(batch: DataFrame, epoch: int) -> None:
        rows = each(batch) if each else batch
        rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    written = spark.read.parquet(out)
    if mode == "update":
        return dedupe(written, keys, ["epoch"], "last").drop("epoch")
    if mode == "complete":
        newest = written.agg(F.max("epoch").alias("epoch"))
        return written.join(F.broadcast(newest), "epoch").drop("epoch")
    return written.drop("epoch")


def dedupe_stream(stream: DataFrame, keys: Sequence[str], ts: str, lateness: str) -> DataFrame:
    """Drop repeats that arrive within the lateness bound; state older than it is let go."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return timed.dropDuplicatesWithinWatermark(list(keys))


def enrich_stream(stream: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Join each micro-batch to a table; a small table is broadcast."""
    return stream.join(small(dim), key, "left")
