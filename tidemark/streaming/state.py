"""State of a stream's own, one row per key, carried from micro-batch to micro-batch in a shared folder.

An epoch writes the rows of the keys it touched; every so many epochs it writes those of all keys, and
what lies before the last such full epoch is deleted. Reading takes the newest row of each wanted key. A
retried epoch reads what was there before it and overwrites what it wrote, so it changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import by_keys
from tidemark.sources.readers import children, delete, exists


class KeyedState:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], full_every: int = 32):
        self.spark, self.path, self.schema, self.keys, self.full_every = spark, path, schema, list(keys), full_every

    def _epochs(self, before: int) -> list[tuple[int, bool]]:
        """Finished epochs before ``before`` since the last full one, in order."""
        found = []
        for name in children(self.spark, self.path):
            epoch, kind = name.removeprefix("epoch-").split("-")
            if int(epoch) < before and exists(self.spark, f"{self.path}/{name}/_SUCCESS"):
                found.append((int(epoch), kind == "full"))
        found.sort()
        full = [i for i, (_, whole) in enumerate(found) if whole]
        return found[full[-1] if full else 0 :]

    def _name(self, epoch: int, full: bool) -> str:
        return f"{self.path}/epoch-{epoch}-{'full' if full else 'part'}"

    def before(self, epoch: int, wanted: DataFrame | None = None) -> DataFrame:
        """The newest rows before ``epoch``, of the keys in ``wanted`` or of all."""
        out = self.spark.createDataFrame([], f"{self.schema}, _epoch bigint")
        for n, full in self._epochs(epoch):
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(self._name(n, full)).withColumn("_epoch", F.lit(n).cast("bigint")))
        if wanted is not None:
            out = by_keys(out, wanted.select(*self.keys).distinct(), self.keys, "left_semi")
        rest = [c for c in out.columns if c not in (*self.keys, "_epoch")]
        newest = out.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_row"))
        return newest.select(*self.keys, "_row.*")

    def write(self, epoch: int, touched: DataFrame) -> None:
        """The rows of the keys that ``epoch`` touched; the other keys keep theirs."""
        past = self._epochs(epoch)
        full = len(past) >= self.full_every
        rows = touched
        if full:
            rows = by_keys(self.before(epoch), touched, self.keys, "left_anti").unionByName(touched)
        delete(self.spark, self._name(epoch, not full))
        rows.write.mode("overwrite").parquet(self._name(epoch, full))
        for name in children(self.spark, self.path):  # no retry reaches behind the last full epoch of the past
            if past and int(name.split("-")[1]) < past[0][0]:
                delete(self.spark, f"{self.path}/{name}")


def run_batches(stream: DataFrame, mode: str, take: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give every micro-batch of what is available to ``take``."""
    (
        stream.writeStream.outputMode(mode).foreachBatch(take).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )
