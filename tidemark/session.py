"""Session construction. Operators never touch session settings; only callers do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **settings: str) -> SparkSession:
    """Session with UTC time, adaptive execution and skew-join handling switched on.

    Shuffle partitions are left to the cluster; pass ``spark_sql_shuffle_partitions="8"`` (dots as
    underscores) for local runs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
