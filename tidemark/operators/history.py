"""Deduplication, versioned dimensions, upserts and schema change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_key

OPEN_END = "9999-12-31"


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key: first or last by ``order`` (NULLs lowest), ties by the other columns in turn.

    Only the first place of a ranking is kept, so every task ranks its own rows before the shuffle and sends one
    row per key: copies meet on the map side, and a key with many copies is no bigger than a task's
    one row when it is shuffled.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    by = [F.col(c).asc_nulls_first() if keep == "first" else F.col(c).desc_nulls_last() for c in [*order, *rest]]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def duplicate_frequency(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys occur once, twice, three times, four times or more."""
    n = F.col("_n")
    label = F.when(n >= 4, "4x+").otherwise(F.concat(n.cast("string"), F.lit("x")))
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(label.alias("copies"))
        .agg(F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("rows"))
    )


def open_dimension(df: DataFrame, key: str, valid_from: str) -> DataFrame:
    """First version of every row, open-ended, with a surrogate key."""
    start = F.to_date(F.lit(valid_from))
    return df.select(
        hash_key([key, start]).alias("version_key"),
        *df.columns,
        start.alias("valid_from"),
        F.to_date(F.lit(OPEN_END)).alias("valid_to"),
        F.lit(True).alias("is_current"),
    )


def scd2_apply(dim: DataFrame, changes: DataFrame, key: str, tracked: Sequence[str]) -> DataFrame:
    """Close the current version the day before ``change_date`` and open a new one, for many keys.

    ``changes`` has the key, ``change_date`` and the tracked columns, at most one row per key. A key
    without a current version, and a change dated before the current version began, are errors raised
    inside the plan. A change of the very day on which the current version began must equal it, and
    then changes nothing, so a rerun is harmless. Past versions pass by; the current ones meet the
    changes in one full join, and a changed row emits both versions.
    """
    wanted = changes.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("change_date").alias("_from"),
        *[F.first(c).alias(f"_new_{c}") for c in tracked],
    ).withColumn(
        "_from", F.when(F.col("_n") > 1, F.raise_error(F.lit("several changes for one key")).cast("date"))
        .otherwise(F.col("_from")),
    ).drop("_n")
    cols = dim.columns
    now = F.coalesce(F.col("is_current"), F.lit(False))
    wanted = wanted.withColumnRenamed(key, "_key")
    both = dim.filter(now).join(wanted, F.col(key) == F.col("_key"), "full_outer")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in tracked])
    start, change = F.col("valid_from"), F.col("_from")

    def error(message: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(F.col("_key").cast("string"), F.lit("null")))).cast("boolean")

    hit = (
        F.when(~F.coalesce(now, F.lit(False)), error("no current version of key"))
        .when(change.isNull() & F.col("_key").isNotNull(), error("change without a date for key"))
        .when(change.isNull(), F.lit(False))
        .when(change < start, error("change before the current version of key"))
        .when(change > start, F.lit(True))
        .when(same, F.lit(False))
        .otherwise(error("a second, different change on one day for key"))
    )

    def version(over: Mapping[str, Column]) -> Column:
        return F.struct(*[over.get(c, F.col(c)).alias(c) for c in cols])

    closed = version({"valid_to": F.date_sub(F.col("_from"), 1), "is_current": F.lit(False)})
    opened = version(
        {
            "version_key": hash_key([key, "_from"]),
            "valid_from": F.col("_from"),
            "valid_to": F.to_date(F.lit(OPEN_END)),
            "is_current": F.lit(True),
            **{c: F.col(f"_new_{c}") for c in tracked},
        }
    )
    rows = F.when(hit, F.array(closed, opened)).otherwise(F.array(version({})))
    return both.select(F.explode(rows).alias("_v")).select("_v.*").unionByName(dim.filter(~now))


def snapshot(dim: DataFrame, source: DataFrame, key: str, check: Sequence[str], as_of: str) -> DataFrame:
    """Compare current versions with ``source``: changed keys get a version, new keys are added."""
    day = F.to_date(F.lit(as_of))
    current = dim.filter("is_current").select(key, *[F.col(c).alias(f"_old_{c}") for c in check], F.lit(True).alias("_known"))
    joined = source.join(current, key, "left")
    differs = reduce(or_, [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in check])
    changed = joined.filter(F.col("_known") & differs).select(key, *check, day.alias("change_date"))
    added = joined.filter(F.col("_known").isNull()).select(*source.columns)
    return scd2_apply(dim, changed, key, check).unionByName(open_dimension(added, key, as_of))


def version_at(dim: DataFrame, day: str) -> DataFrame:
    """The versions valid on one day."""
    return dim.filter(F.to_date(F.lit(day)).between(F.col("valid_from"), F.col("valid_to")))


def merge(
    target: DataFrame, source: DataFrame, keys: Sequence[str], condition: Column | None = None
) -> DataFrame:
    """Upsert: matched rows are replaced (where ``condition`` holds), unmatched rows inserted.

    ``condition`` may refer to ``target.<col>`` and ``source.<col>``. Adds ``change``
    (unchanged, updated, inserted). Two source rows with one key are an error. A matched row that
    already equals the source is 'unchanged', so a second run reports nothing new.
    """
    values = [c for c in target.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in values])
    src = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(packed).alias("_src"))
    src = src.withColumn(
        "_src",
        F.when(F.col("_n") == 1, F.col("_src")).otherwise(
            F.raise_error(F.lit("several source rows for one key")).cast(src.schema["_src"].dataType)
        ),
    ).drop("_n")
    tgt = target.select(*keys, packed.alias("_tgt"))
    both = tgt.join(src, list(keys), "full_outer").select(
        *keys, F.col("_tgt").alias("target"), F.col("_src").alias("source")
    )
    has_t, has_s = F.col("target").isNotNull(), F.col("source").isNotNull()
    fires = has_t & has_s & ~F.col("target").eqNullSafe(F.col("source"))
    if condition is not None:
        fires = fires & F.coalesce(condition, F.lit(False))
    change = F.when(~has_t, "inserted").when(fires, "updated").otherwise("unchanged")
    row = F.when(~has_t | fires, F.col("source")).otherwise(F.col("target"))
    out = both.select(*keys, row.alias("_row"), change.alias("change"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in target.columns], "change")


def merge_audit(merged: DataFrame) -> DataFrame:
    """Rows per kind of change."""
    return merged.groupBy("change").agg(F.count(F.lit(1)).alias("rows"))


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between two frames (schema only; no data is read)."""
    old, new = dict(a.dtypes), dict(b.dtypes)
    rows = [(c, "added", None, t) for c, t in new.items() if c not in old]
    rows += [(c, "removed", t, None) for c, t in old.items() if c not in new]
    rows += [(c, "type_changed", old[c], t) for c, t in new.items() if c in old and old[c] != t]
    return a.sparkSession.createDataFrame(
        rows, "column_name string, change string, old_type string, new_type string"
    )


def union_evolved(old: DataFrame, new: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Union by name; rows from before a column existed take its default."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.fillna(dict(defaults))
