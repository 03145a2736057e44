"""Event-time windows. Each function takes a batch frame or a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import lay_out, running
from tidemark.scratch import materialise


def event_time(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Watermarks need a zoned timestamp; session time is UTC, so the instant stays the same."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def _flat(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    return df.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggs
    )


def tumbling(df: DataFrame, ts: str, size: str, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Fixed windows that do not overlap."""
    grouped = df.groupBy(F.window(ts, size), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return _flat(grouped, keys, aggs)


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Windows of ``size`` starting every ``slide``."""
    grouped = df.groupBy(F.window(ts, size, slide), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return _flat(grouped, keys, aggs)


def sliding_panes(df: DataFrame, ts: str, size: str, slide: str, value: str, user: str) -> DataFrame:
    """Sliding windows as unions of panes: rows, sum of ``value`` and exact distinct ``user`` (a whole number).

    Rows are aggregated once, into panes of one slide; ``size`` must be a multiple of ``slide``. Only panes are then
    copied to the windows they belong to: sums add up, and the users are bitmaps that are or-ed. Batch frame, or a
    stream with a watermark in append mode. Rows without a user count in ``rows`` and ``sum_value``.
    """
    pane = F.window(ts, slide).alias("pane")
    panes = df.groupBy(pane, F.bitmap_bucket_number(F.col(user).cast("bigint")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(value).alias("sum_value"), F.bitmap_construct_agg(F.bitmap_bit_position(F.col(user).cast("bigint"))).alias("users"))
    within = F.window(F.window_time("pane"), size, slide).alias("window")
    parts = panes.groupBy(within, "bucket").agg(
        F.sum("rows").alias("rows"), F.sum("sum_value").alias("sum_value"), F.bitmap_or_agg("users").alias("users"))
    users = F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("users")).otherwise(0))
    return _flat(parts.groupBy("window").agg(F.sum("rows").alias("rows"), F.sum("sum_value").alias("sum_value"), users.alias("users")), ["rows", "sum_value", "users"], {})


def rank_in_window(counted: DataFrame, key: str, n: int) -> DataFrame:
    """Best keys of each window of a finished count (window_start, key, rows)."""
    w = Window.partitionBy("window_start").orderBy(F.col("rows").desc(), key)
    ranked = counted.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    return ranked.select("window_start", "place", key, "rows")


def top_in_window(df: DataFrame, ts: str, size: str, key: str, n: int) -> DataFrame:
    """Most frequent keys per window (batch); a stream ranks in ``foreachBatch`` as windows close."""
    return rank_in_window(tumbling(df, ts, size, [key], {"rows": F.count(F.lit(1))}), key, n)


def _session_columns(count: Column, first: Column, last: Column) -> dict[str, Column]:
    seconds = F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    duration = seconds / F.lit(1000000)
    rate = count / F.greatest(duration / 60, F.lit(1.0))
    return {"duration_sec": duration, "per_minute": rate, "is_surge": rate > 5}


def sessions(df: DataFrame, key: str, ts: str, gap_sec: int, order: Sequence[str], value: str) -> DataFrame:
    """Runs of activity per key; rows up to ``gap_sec`` apart belong together (batch).

    The gap to the previous row and the start of the run are running maxima over ranges, so one
    key with much of the data is not sorted in one task.
    """
    stamp = F.unix_micros(F.col(ts).cast("timestamp"))
    keyed = df.select(key, ts, *[c for c in order if c != ts], value, stamp.alias("_us"))
    laid = lay_out(keyed, [key], order)
    linked = running(laid, [key], order, {"_prev": ("max", F.col("_us"))}, exclusive=True)
    opens = F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > gap_sec * 1000000)
    # Written, because the second pass reads its rows twice: once for the slot totals, once for the rows.
    marked = materialise(linked.withColumn("_open", F.when(opens, F.col("_us"))).drop("_prev"), "sessions")
    placed = running(marked, [key], order, {"_run": ("max", F.col("_open"))})
    out = placed.groupBy(key, "_run").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"),
        F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total_value"),
    )
    derived = _session_columns(F.col("rows"), F.col("session_start"), F.col("session_end"))
    return out.drop("_run").withColumns(derived)


def sessions_stream(stream: DataFrame, key: str, ts: str, gap: str, value: str) -> DataFrame:
    """The same over a stream (``ts`` watermarked): emitted when a session can no longer grow."""
    grouped = stream.groupBy(key, F.session_window(ts, gap).alias("w")).agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"),
        F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total_value"),
    )
    derived = _session_columns(F.col("rows"), F.col("session_start"), F.col("session_end"))
    return grouped.drop("w").withColumns(derived)


def session_stats(found: DataFrame) -> DataFrame:
    """Figures over all sessions."""
    micros = F.sum(F.round(F.col("duration_sec") * 1000000).cast("bigint"))
    return found.agg(
        F.count(F.lit(1)).alias("sessions"),
        (micros / F.count(F.lit(1)) / 1000000).alias("avg_duration_sec"),
        F.max("duration_sec").alias("max_duration_sec"),
        F.count_if("is_surge").alias("surges"),
        (F.sum("rows") / F.count(F.lit(1))).alias("avg_rows"),
        F.round(F.sum("total_value"), 2).cast("double").alias("total_value"),
    )
