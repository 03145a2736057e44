"""Live figures: running totals, active users, trends, surges and current state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.amounts import mean
from tidemark.streaming.state import KeyedState, run_batches


def running_counts(stream: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows, sum and mean per key so far; use output mode ``complete`` or ``update``."""
    return stream.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum(value), 2).cast("double").alias("sum_value"),
        mean(value).alias("avg_value"),
    )


def latest(df: DataFrame, ts: str) -> DataFrame:
    """One row with the newest event time: the ``as_of`` of a finished stream."""
    return df.agg(F.max(ts).alias("as_of"))


def _trailing(df: DataFrame, ts: str, span: str, as_of: DataFrame) -> DataFrame:
    """Rows of the trailing span. The edge is a scalar subquery, so the filter stands at the scan."""
    until = as_of.scalar()
    return df.filter((F.col(ts) >= until - F.expr(f"interval {span}")) & (F.col(ts) <= until))


def active_users(df: DataFrame, ts: str, user: str, span: str, as_of: DataFrame, only: Column | None = None) -> DataFrame:
    """Distinct users in the trailing span."""
    rows = _trailing(df, ts, span, as_of)
    rows = rows if only is None else rows.filter(only)
    return rows.agg(F.count_distinct(user).alias("active_users"))


def active_users_stream(stream: DataFrame, ts: str, user: str, span: str, slide: str) -> DataFrame:
    """Sliding estimate for a stream: a sketch per window instead of a set of users."""
    return stream.groupBy(F.window(ts, span, slide)).agg(
        F.approx_count_distinct(user).alias("active_users")
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "active_users")


def trending(df: DataFrame, ts: str, key: str, span: str, as_of: DataFrame, n: int) -> DataFrame:
    """Keys by growth of the last span against the span before: (recent − before) / max(before, 1)."""
    step = F.expr(f"interval {span}")
    until = as_of.scalar()
    edge = until - step
    rows = df.filter((F.col(ts) >= edge - step) & (F.col(ts) <= until))
    counted = rows.groupBy(key).agg(
        F.count_if(F.col(ts) >= edge).alias("recent"), F.count_if(F.col(ts) < edge).alias("before")
    )
    score = (F.col("recent") - F.col("before")) / F.greatest(F.col("before"), F.lit(1))
    return counted.withColumn("score", score).orderBy(F.col("score").desc(), F.col("recent").desc(), key).limit(n)


def recent_by(df: DataFrame, ts: str, attr: str, user: str, span: str, as_of: DataFrame) -> DataFrame:
    """Events and distinct users per attribute in the trailing span."""
    return _trailing(df, ts, span, as_of).groupBy(attr).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(user).alias("users")
    )


def per_minute(df: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    """Events per minute and key; batch or stream."""
    return df.groupBy(F.window(ts, "1 minute").alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows")).select(
        F.col("w.start").alias("minute"), *keys, "rows"
    )


def surge(df: DataFrame, ts: str, size: str, key: str, value: str, factor: float, baseline: int) -> DataFrame:
    """Windows whose mean exceeds ``factor`` times the mean of the key's earlier windows."""
    return flag_surges(window_sums(df, ts, size, key, value), key, factor, baseline)


def window_sums(df: DataFrame, ts: str, size: str, key: str, value: str) -> DataFrame:
    """Sum and count per window and key; batch, or a stream with a watermark in append mode."""
    return df.groupBy(F.window(ts, size).alias("w"), key).agg(F.sum(value).alias("window_sum"), F.count(value).alias("window_rows")).select(
        F.col("w.start").alias("window_start"), key, "window_sum", "window_rows"
    )


def flag_surges(closed: DataFrame, key: str, factor: float, baseline: int, more: Sequence[str] = ()) -> DataFrame:
    """Compare closed windows with the ``baseline`` windows before them. The frame runs over windows, not rows.

    Columns of ``more`` are passed on.
    """
    before = Window.partitionBy(key).orderBy("window_start").rowsBetween(-baseline, -1)
    mean_of = lambda s, n: F.try_divide(s.cast("double"), n)
    base = mean_of(F.sum("window_sum").over(before), F.sum("window_rows").over(before))
    rows = closed.withColumns({"window_mean": mean_of(F.col("window_sum"), F.col("window_rows")), "base_mean": base})
    flagged = F.coalesce(F.col("window_mean") > factor * F.col("base_mean"), F.lit(False))
    return rows.withColumn("is_surge", flagged).select("window_start", key, "window_mean", "base_mean", "is_surge", *more)


class SurgeSink:
    """Flags surges as windows close, batch by batch; for the closed windows of :func:`window_sums`.

    The last ``baseline`` windows of each key are kept as state. A batch writes its windows with their
    flags to a directory of its own under ``out/flags`` and overwrites it when retried. Windows of one key
    close in order, so a batch needs no more than its own windows and the state.
    """

    def __init__(self, spark: SparkSession, out: str, key: str, kinds: Mapping[str, str], factor: float, baseline: int, full_every: int = 32):
        self.spark, self.out, self.key, self.factor, self.baseline = spark, out, key, factor, baseline
        self.kinds = {c: kinds[c] for c in ("window_start", key, "window_sum", "window_rows")}
        window = ", ".join(f"{c}: {k}" for c, k in self.kinds.items() if c != key)
        self.state = KeyedState(spark, f"{out}/state", f"`{key}` {self.kinds[key]}, history array<struct<{window}>>", [key], full_every)

    def take(self, batch: DataFrame, epoch: int) -> None:
        closed = f"{self.out}/closed/epoch={epoch}"
        batch.select(*self.kinds).write.mode("overwrite").parquet(closed)  # the stream's own state is read once
        now = self.spark.read.schema(batch.select(*self.kinds).schema).parquet(closed)
        past = self.state.before(epoch, now).select(self.key, F.inline("history"))
        both = now.withColumn("_new", F.lit(True)).unionByName(past.withColumn("_new", F.lit(False)))
        flagged = flag_surges(both, self.key, self.factor, self.baseline, ["_new"]).filter("_new").drop("_new")
        flagged.write.mode("overwrite").parquet(f"{self.out}/flags/epoch={epoch}")
        newest = Window.partitionBy(self.key).orderBy(F.col("window_start").desc())
        last = both.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= self.baseline)
        window = F.struct(*[c for c in self.kinds if c != self.key])
        self.state.write(epoch, last.groupBy(self.key).agg(F.sort_array(F.collect_list(window)).alias("history")))

    def flags(self) -> DataFrame:
        """Everything flagged so far."""
        return self.spark.read.parquet(f"{self.out}/flags").drop("epoch")


def surge_stream(stream: DataFrame, ts: str, size: str, key: str, value: str, factor: float, baseline: int, out: str, checkpoint: str) -> DataFrame:
    """Take what is available of a watermarked stream, flagging windows in the batch that closes them."""
    closed = window_sums(stream, ts, size, key, value)
    sink = SurgeSink(stream.sparkSession, out, key, dict(closed.dtypes), factor, baseline)
    run_batches(closed, "append", sink.take, checkpoint)
    return sink.flags()


def hub_monitor(df: DataFrame, ts: str, size: str, key: str, hubs: Sequence[str]) -> DataFrame:
    """Per window: all rows, rows of each hub, and their share; batch, or a stream with a watermark."""
    counts = {h: F.count_if(F.col(key) == h) for h in hubs}
    rows = F.count(F.lit(1))
    return df.groupBy(F.window(ts, size).alias("w")).agg(
        rows.alias("rows"), *[c.alias(f"{h}_rows") for h, c in counts.items()],
        (sum(counts.values(), F.lit(0)) / rows).alias("hub_share"),
    ).select(F.col("w.start").alias("window_start"), "rows", *[f"{h}_rows" for h in hubs], "hub_share")


def current_state(changelog: DataFrame, key: str, delta: Column) -> DataFrame:
    """Fold a changelog of +1/−1 into the current count per key; batch or stream."""
    return changelog.groupBy(key).agg(F.sum(delta).alias("active"))


def key_partitions(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows and keys per partition when rows follow a digest of their key."""
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    part = (digest % n).cast("int")
    return df.groupBy(part.alias("partition_no")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")
    )
