"""A quality gate inside a stream: micro-batches are checked before the table sees them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quality import GateOpen, circuit, first_failure
from tidemark.sources.readers import delete, exists, publish
from tidemark.streaming.state import run_batches


class GateSink:
    """Valid rows go to ``out/table``, rows that fail a rule to ``out/quarantine`` with the reason.

    A batch is staged in one evaluation, and its figures are observed while it is written. The percent of
    rows that pass every rule is its score. When the gate is OPEN the batch stays under ``out/halted``, nothing is
    published and the stream stops with ``GateOpen``; a restart meets the same batch again. Otherwise both parts
    are put in place by renaming, each in a directory of the epoch, which a retry replaces. The
    decision on every batch is kept under ``out/decisions``. An empty batch passes.
    """

    def __init__(self, spark: SparkSession, out: str, name: str, rules: Sequence[tuple[str, Column]], **limits: float):
        self.spark, self.out, self.name, self.rules, self.limits = spark, out, name, list(rules), limits

    def take(self, batch: DataFrame, epoch: int) -> None:
        staged = f"{self.out}/_staged/epoch={epoch}"
        reason, seen = first_failure(self.rules), Observation()
        marked = batch.withColumn("reason", reason).withColumn("_part", F.when(F.col("reason").isNull(), "table").otherwise("quarantine"))
        failed = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"rule_{i}") for i, (_, ok) in enumerate(self.rules)]
        marked = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("reason").isNull()).alias("passed"), *failed)
        marked.write.mode("overwrite").partitionBy("_part").parquet(staged)
        found = seen.get
        rows, passed = found["rows"], found["passed"]
        overall = 100.0 * passed / rows if rows else 100.0
        figures = [(self.name, rows, passed, overall, {n: found[f"rule_{i}"] for i, (n, _) in enumerate(self.rules)})]
        decision = self.spark.createDataFrame(figures, "dataset string, rows bigint, passed bigint, overall double, failures map<string, bigint>")
        state = circuit(decision, **self.limits)
        decision.join(state.select("dataset", "state", "severity"), "dataset").coalesce(1).write.mode("overwrite").parquet(f"{self.out}/decisions/epoch={epoch}")
        if state.first()["state"] == "OPEN":
            publish(self.spark, staged, f"{self.out}/halted/epoch={epoch}")
            raise GateOpen(f"quality gate open for {self.name}: {passed} of {rows} rows pass in batch {epoch}")
        for part in ("table", "quarantine"):
            publish(self.spark, f"{staged}/_part={part}", f"{self.out}/{part}/epoch={epoch}")
        delete(self.spark, staged)
        delete(self.spark, f"{self.out}/halted/epoch={epoch}")

    def read(self, part: str, schema: T.StructType) -> DataFrame:
        """``table``, ``quarantine`` or ``halted`` rows, none yet included; the reason is null for valid rows."""
        kept = T.StructType([*schema.fields, T.StructField("reason", T.StringType())])
        place = f"{self.out}/{part}"
        return self.spark.read.schema(kept).parquet(place) if exists(self.spark, place) else self.spark.createDataFrame([], kept)


def gate_stream(stream: DataFrame, out: str, checkpoint: str, name: str, rules: Sequence[tuple[str, Column]], **limits: float) -> GateSink:
    """Take what is available through the gate."""
    sink = GateSink(stream.sparkSession, out, name, rules, **limits)
    run_batches(stream, "append", sink.take, checkpoint)
    return sink
