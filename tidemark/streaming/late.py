"""Late rows: deriving arrivals, classifying against a watermark, keeping what is dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranges import lay_out, running
from tidemark.sources.readers import delete, exists, publish


def with_arrival(df: DataFrame, ts: str, key: str, every: int = 20, late: str = "2 hours", usual: str = "1 second") -> DataFrame:
    """Arrival time: one row in ``every`` comes ``late``, the others after ``usual``."""
    delay = F.when(F.pmod(F.col(key), F.lit(every)) == 0, F.expr(f"interval {late}")).otherwise(F.expr(f"interval {usual}"))
    return df.withColumn("arrival", F.col(ts) + delay)


def classify_late(df: DataFrame, ts: str, arrival: Sequence[str], lateness_sec: int, window_sec: int) -> DataFrame:
    """Status of each row against the watermark when it arrives.

    The watermark is the greatest event time seen so far less the allowed lateness, moved by every
    row. ``dropped`` rows lie behind it; ``late_open`` rows too, but their window has not closed.
    The running maximum over arrival order is taken over ranges: one global window would be one task.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    laid = lay_out(df.withColumn("_us", micros), [], arrival)
    seen = running(laid, [], arrival, {"_max": ("max", F.col("_us"))}).drop("_slot")
    mark = F.col("_max") - lateness_sec * 1000000
    span = window_sec * 1000000
    closes = (F.floor(F.col("_us") / span) + 1) * span
    status = (
        F.when(F.col("_us") >= mark, "on_time").when(closes > mark, "late_open").otherwise("dropped")
    )
    lag = F.when(F.col("_us") < mark, (mark - F.col("_us")) / F.lit(1000000))
    return seen.withColumns({"status": status, "lag_sec": lag}).drop("_us", "_max")


def lateness_summary(classified: DataFrame, value: str) -> DataFrame:
    """Rows, worst lag and value per status."""
    return classified.groupBy("status").agg(
        F.count(F.lit(1)).alias("rows"), F.max("lag_sec").alias("max_lag_sec"),
        F.round(F.sum(value), 2).cast("double").alias("sum_value"),
    )


def split_late(stream: DataFrame, ts: str, lateness: str, out: str, checkpoint: str) -> None:
    """Take what is available; rows behind the watermark go to ``out/late``, the rest to ``out/kept``.

    The watermark moves per micro-batch: it is the greatest event time of *earlier* batches less the
    lateness. A batch is evaluated once: it is staged by part, its own greatest time is read from what was
    written and noted under ``out/marks``, and the parts are put in place by renaming. All three are
    replaced when a batch is retried, so a restart neither loses nor repeats a row.
    """
    spark = stream.sparkSession

    def take(batch: DataFrame, epoch: int) -> None:
        mark = F.lit(None).cast("timestamp_ntz")
        if exists(spark, f"{out}/marks"):
            past = spark.read.parquet(f"{out}/marks").filter(F.col("epoch") < epoch)
            seen = past.agg(F.max("seen").alias("m")).first()["m"]
            mark = F.lit(seen).cast("timestamp_ntz") - F.expr(f"interval {lateness}")
        behind = F.coalesce(F.col(ts) < mark, F.lit(False))
        staged = f"{out}/_staged/epoch={epoch}"
        rows = batch.withColumns({"watermark": F.when(behind, mark), "_part": F.when(behind, "late").otherwise("kept")})
        rows.write.mode("overwrite").partitionBy("_part").parquet(staged)
        written = spark.read.schema(batch.schema).parquet(staged)
        written.agg(F.max(ts).alias("seen")).write.mode("overwrite").parquet(f"{out}/marks/epoch={epoch}")
        for part in ("kept", "late"):
            if not exists(spark, f"{staged}/_part={part}"):
                spark.createDataFrame([], rows.drop("_part").schema).write.mode("overwrite").parquet(f"{staged}/_part={part}")
            publish(spark, f"{staged}/_part={part}", f"{out}/{part}/epoch={epoch}")
        delete(spark, staged)

    query = (
        stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
