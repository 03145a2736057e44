"""Silver tables: harmonise, clean, dedupe, derive, split into valid and quarantined rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import safe_divide, touches
from tidemark.functions.times import is_rush_hour, minutes_between
from tidemark.operators.history import dedupe
from tidemark.operators.projections import harmonise
from tidemark.operators.quality import first_failure, split


@dataclass(frozen=True)
class SilverSpec:
    """How one source becomes a silver table."""

    tag: str | Column
    mapping: Mapping[str, str | Column]
    keys: Sequence[str]
    order: Sequence[str]
    not_negative: Sequence[str] = ()
    hubs: Sequence[int] = ()
    places: Sequence[str] = ("from_nation", "to_nation")
    has_distance: bool = True
    minutes: tuple[float, float] = (0.5, 720)
    max_speed: float = 100
    extra: Mapping[str, Column] = field(default_factory=dict)


def derive(df: DataFrame, spec: SilverSpec) -> DataFrame:
    """Duration, speed, hub flag, rush flag, date and the source's own extra columns."""
    out = df.withColumn("duration_min", minutes_between("started", "ended"))
    added = {"is_rush": is_rush_hour("started"), "day": F.to_date("started")}
    if spec.has_distance:
        speed = F.when(
            F.col("duration_min") > 0, safe_divide("distance", F.col("duration_min") / 60)
        )
        added["speed"] = speed
    if spec.hubs:
        added["is_hub"] = touches(spec.places, spec.hubs)
    return out.withColumns({**added, **spec.extra})


def drop_rules(spec: SilverSpec) -> list[tuple[str, Column]]:
    """Rows that fail one of these are dropped: both times must be known and money not negative."""
    timed = F.col("started").isNotNull() & F.col("ended").isNotNull()
    return [("missing_time", timed), *[(f"negative_{c}", F.col(c) >= 0) for c in spec.not_negative]]


def quarantine_rules(spec: SilverSpec) -> list[tuple[str, Column]]:
    """Rows that fail one of these are set aside with the reason."""
    rules = [("duration", F.col("duration_min").between(*spec.minutes))]
    if spec.has_distance:
        rules.append(("speed", F.col("speed").isNull() | (F.col("speed") < spec.max_speed)))
    return rules


def cleaned(raw: DataFrame, spec: SilverSpec) -> DataFrame:
    """Harmonised rows that no drop rule rejects, one per key, with the derived columns."""
    df = harmonise(raw, spec.mapping, spec.tag)
    return derive(dedupe(df.filter(first_failure(drop_rules(spec)).isNull()), spec.keys, spec.order), spec)


def silver(raw: DataFrame, spec: SilverSpec) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined rows with their reason; :func:`accounting` tells what was dropped before."""
    return split(cleaned(raw, spec), quarantine_rules(spec))


def accounting(raw: DataFrame, spec: SilverSpec) -> DataFrame:
    """Where every raw row went, as (outcome, rule, rows), in one pass.

    Outcomes are dropped, duplicate, quarantine and valid; their rows add up to the raw rows. Rejected
    rows are one group per rule, so they shrink on the map side.
    """
    df = harmonise(raw, spec.mapping, spec.tag).withColumn("_rule", first_failure(drop_rules(spec)))
    kept = F.col("_rule").isNull()
    rest = [c for c in df.columns if c not in spec.keys and c != "_rule"]
    row = F.struct(*[F.col(c) for c in [*[o for o in spec.order if o in rest], *[c for c in rest if c not in spec.order]]])
    keys = [F.when(kept, F.col(k)).alias(k) for k in spec.keys]
    one = df.groupBy("_rule", *keys).agg(F.count(F.lit(1)).alias("_rows"), F.min(F.when(kept, row)).alias("_row"))
    one = derive(one.select("_rule", "_rows", *spec.keys, "_row.*"), spec)
    reason = first_failure(quarantine_rules(spec))
    outcome = lambda name, rule, n: F.struct(F.lit(name).alias("outcome"), rule.alias("rule"), n.cast("bigint").alias("rows"))
    none = F.lit(None).cast("string")
    parts = F.when(F.col("_rule").isNotNull(), F.array(outcome("dropped", F.col("_rule"), F.col("_rows")))).otherwise(
        F.array(
            outcome("duplicate", none, F.col("_rows") - 1),
            F.struct(F.when(reason.isNull(), "valid").otherwise("quarantine").alias("outcome"), reason.alias("rule"), F.lit(1).cast("bigint").alias("rows")),
        )
    )
    return one.select(F.inline(parts)).groupBy("outcome", "rule").agg(F.sum("rows").alias("rows")).filter("rows > 0")
