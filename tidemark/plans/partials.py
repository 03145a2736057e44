"""Gold tables kept as mergeable partial states, refreshed period by period.

The store holds one row per period and dimension values with sums, counts, least and greatest values and sketches,
and, for exact distinct counts of whole numbers, bitmaps in a table of their own. A refresh reads the
rows of its periods only and replaces those periods; a restated day replaces what it had given. Every
coarser figure is folded from the stored states, never from the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sets import stack
from tidemark.sources.readers import delete, exists
from tidemark.sources.writers import write_period

#: How a kind of measure is made from rows, and merged; a mean is a sum and a count.
_STATES = {
    "sum": {"sum": (F.sum, F.sum)}, "count": {"count": (F.count, F.sum)}, "min": {"min": (F.min, F.min)}, "max": {"max": (F.max, F.max)},
    "mean": {"sum": (F.sum, F.sum), "count": (F.count, F.sum)}, "about_distinct": {"sketch": (F.hll_sketch_agg, F.hll_union_agg)},
}


@dataclass(frozen=True)
class Measure:
    """``kind`` is one of sum, count, min, max, mean, about_distinct (sketch) or distinct (exact, whole numbers)."""

    kind: str
    column: Column


class PartialStore:
    """States under ``path`` by ``period`` (a column of the rows) and ``dims``. Sum decimals, so that folds are exact."""

    def __init__(self, spark: SparkSession, path: str, period: str, dims: Sequence[str], measures: Mapping[str, Measure]):
        self.spark, self.path, self.period, self.dims = spark, path, period, list(dims)
        self.distinct = {n: m for n, m in measures.items() if m.kind == "distinct"}
        self.plain = {n: m for n, m in measures.items() if m.kind != "distinct"}
        self.measures = dict(measures)

    def refresh(self, rows: DataFrame) -> None:
        """Take the rows of whole periods; what the store had of these periods is replaced.

        One scan for the plain measures and one for the bitmaps; both are combined on the map side. The two tables
        are written one after the other: after a failure in between, refresh the same periods again.
        """
        keys = [self.period, *self.dims]
        states = [make(m.column).alias(f"{n}__{s}") for n, m in self.plain.items() for s, (make, _) in _STATES[m.kind].items()]
        write_period(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *states), f"{self.path}/plain", self.period)
        if self.distinct:
            values = F.explode(F.array(*[F.struct(F.lit(n).alias("_measure"), m.column.cast("bigint").alias("_v")) for n, m in self.distinct.items()]))
            long = rows.select(*keys, values.alias("_x")).select(*keys, "_x.*")  # periods without values take their place too
            bucket, at = F.bitmap_bucket_number("_v").alias("_bucket"), F.bitmap_construct_agg(F.bitmap_bit_position("_v")).alias("_bits")
            write_period(long.groupBy(*keys, "_measure", bucket).agg(at), f"{self.path}/distinct", self.period)

    def drop(self, periods: Sequence[object]) -> None:
        """Forget periods, for example one whose rows have all been withdrawn."""
        for name in ("plain", "distinct"):
            for p in periods:
                delete(self.spark, f"{self.path}/{name}/{self.period}={p}")

    def periods(self) -> DataFrame:
        """Periods held, from the partition directories and the rows they hold."""
        return self.spark.read.parquet(f"{self.path}/plain").groupBy(self.period).agg(F.sum("_rows").alias("rows"))

    def fold(self, by: Mapping[str, Column], where: Column | None = None) -> DataFrame:
        """Every measure by columns of periods and dimensions; ``where`` picks periods and dimensions.

        A condition on the period prunes directories. Plain and distinct figures are stacked and meet in
        one aggregate, so groups with null dimensions stay.
        """
        def kept(name: str) -> DataFrame:
            held = self.spark.read.parquet(f"{self.path}/{name}")
            return held if where is None else held.filter(where)

        groups = [c.alias(n) for n, c in by.items()]
        states = {f"{n}__{s}": merge for n, m in self.plain.items() for s, (_, merge) in _STATES[m.kind].items()}
        folded = kept("plain").groupBy(*groups).agg(*[merge(s).alias(s) for s, merge in states.items()])
        names = [*by, *self.measures]
        out = [folded.select(*by, *[(F.lit(None).cast("bigint") if m.kind == "distinct" else _finish(n, m.kind)).alias(n) for n, m in self.measures.items()])]
        if self.distinct and exists(self.spark, f"{self.path}/distinct"):
            united = kept("distinct").filter("_bucket IS NOT NULL").groupBy(*groups, "_measure", "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))
            counts = [F.sum(F.when(F.col("_measure") == n, F.bitmap_count("_bits"))).alias(n) for n in self.distinct]
            types = dict(out[0].dtypes)
            counted = united.groupBy(*by).agg(*counts)
            out.append(counted.select(*by, *[F.col(n) if n in self.distinct else F.lit(None).cast(types[n]).alias(n) for n in self.measures]))
        meet = [F.coalesce(F.max(n), F.lit(0)).alias(n) if n in self.distinct else F.max(n).alias(n) for n in self.measures]
        return stack([o.select(*names) for o in out]).groupBy(*by).agg(*meet)


def _finish(name: str, kind: str) -> Column:
    if kind == "mean":
        return F.try_divide(F.col(f"{name}__sum").cast("double"), F.col(f"{name}__count"))
    if kind == "about_distinct":
        return F.hll_sketch_estimate(f"{name}__sketch")
    return F.col(f"{name}__{kind}")
