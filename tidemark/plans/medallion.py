"""Bronze → silver → gold in one run, each layer written once and checked."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import first_failure
from tidemark.plans.gold import daily_metrics, with_places, zone_performance
from tidemark.plans.silver import SilverSpec, cleaned, quarantine_rules


class LayerCheckFailed(AssertionError):
    """A layer was written but broke one of its promises."""


def write_split(df: DataFrame, rules: Sequence[tuple[str, Column]], path: str, by: Sequence[str] = (), watch: Mapping[str, Column] | None = None) -> Mapping[str, int]:
    """Write valid and quarantined rows in one pass, as partitions ``part=valid|quarantine``.

    The rebalance hint lets adaptive execution size the writers. ``watch`` are aggregates over the
    written rows, observed during the write; the reason and part may be used in them.
    """
    reason = first_failure(rules)
    part = F.when(reason.isNull(), "valid").otherwise("quarantine")
    marked = df.withColumns({"reason": reason, "part": part}).hint("rebalance", F.col("part"), *[F.col(c) for c in by])
    seen = Observation()
    watched = {"rows": F.count(F.lit(1)), **(watch or {})}
    observed = marked.observe(seen, *[c.alias(n) for n, c in watched.items()])
    observed.write.mode("overwrite").partitionBy("part", *by).parquet(path)
    return seen.get


def write_counted(df: DataFrame, path: str) -> int:
    """Write a table and count its rows on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def run_medallion(spark: SparkSession, raw: DataFrame, places: DataFrame, spec: SilverSpec, out: str) -> DataFrame:
    """Write all layers under ``out`` and return one summary row per table.

    Layers hand over by files, so each is computed once and a lost executor re-reads it. Row counts and
    the promises of a layer are observed while it is written; what a layer breaks fails the run before
    the next one starts. The weekday profile follows from the daily table, so silver is read twice.
    """
    stamped = raw.withColumns(
        {"_batch_id": F.lit(uuid.uuid4().hex), "_source_table": F.lit(str(spec.tag)), "_ingested_at": F.current_timestamp()}
    )
    n = {("bronze", "trips"): write_counted(stamped, f"{out}/bronze/trips"), ("bronze", "places"): write_counted(places, f"{out}/bronze/places")}
    bronze = spark.read.schema(stamped.schema).parquet(f"{out}/bronze/trips")
    dims = spark.read.schema(places.schema).parquet(f"{out}/bronze/places")

    valid_row = F.col("part") == "valid"
    promises = {f"negative_{c}": F.col(c) < 0 for c in spec.not_negative}
    promises |= {"backwards": F.col("ended") < F.col("started"), "incomplete": F.col("started").isNull() | F.col("ended").isNull()}
    watch = {"valid": F.count_if(valid_row), **{k: F.count_if(valid_row & c) for k, c in promises.items()}}
    seen = write_split(cleaned(bronze, spec), quarantine_rules(spec), f"{out}/silver/trips", watch=watch)
    if bad := {k: seen[k] for k in promises if seen[k]}:
        raise LayerCheckFailed(f"rows breaking a promise: {bad}")
    n |= {("silver", "trips"): seen["valid"], ("silver", "quarantine"): seen["rows"] - seen["valid"]}

    valid = spark.read.parquet(f"{out}/silver/trips").filter(valid_row)
    n["gold", "daily_metrics"] = write_counted(daily_metrics(valid), f"{out}/gold/daily_metrics")
    n["gold", "zone_performance"] = write_counted(zone_performance(with_places(valid, dims), "from"), f"{out}/gold/zone_performance")
    daily = spark.read.parquet(f"{out}/gold/daily_metrics")
    profile = daily.groupBy(F.weekday("day").alias("dow")).agg(F.sum("trips").alias("trips"))
    n["gold", "weekday_profile"] = write_counted(profile, f"{out}/gold/weekday_profile")
    summary = [F.struct(F.lit(layer).alias("layer"), F.lit(name).alias("table_name"), F.lit(v).cast("long").alias("rows")) for (layer, name), v in n.items()]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*summary)))
