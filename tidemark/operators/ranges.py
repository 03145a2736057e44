"""Running aggregates over a global or per-key order, without putting an order in one task.

A plain window sends each partition key to one task; with no key, or a key holding a third of the
rows, that task is the job. Here rows are range-partitioned by ``keys + order`` (a total order, so
a hot key spreads over many slots), written once, and each slot is scanned on its own. Slot totals
are then carried forward: there are at most as many (key, slot) pairs as keys plus slots, and the
carry of every earlier slot is joined back on (key, slot).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import materialise

_AGG = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}
_MERGE = {**_AGG, "count": F.sum}


def lay_out(df: DataFrame, keys: Sequence[str], order: Sequence[str], slots: int | None = None) -> DataFrame:
    """Assign each row a slot of the global order and fix it by writing the frame to scratch.

    ``keys + order`` must identify rows up to exact ties, as for any deterministic window. The
    write also pins slot numbers, which a recomputed range partitioning might draw differently.
    ``slots`` defaults to the session's shuffle partitions, which adaptive execution may merge.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(slots, *by) if slots else df.repartitionByRange(*by)
    return materialise(ranged.withColumn("_slot", F.spark_partition_id()), "ranges")


def running(
    laid: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: Mapping[str, tuple[str, Column]],
    exclusive: bool = False,
) -> DataFrame:
    """Add ``{name: (count|sum|max|min, column)}`` running over ``order`` within ``keys``.

    ``laid`` comes from :func:`lay_out` with the same keys and order. ``exclusive`` leaves the
    current row out of its own value.
    """
    by = [*keys, "_slot"]
    scan = Window.partitionBy(*by).orderBy(*order)
    frame = scan.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    local = laid.withColumns({f"_l_{n}": _AGG[a](c).over(frame) for n, (a, c) in outputs.items()})

    totals = laid.groupBy(*by).agg(*[_AGG[a](c).alias(f"_t_{n}") for n, (a, c) in outputs.items()])
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *by, *[_MERGE[a](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (a, _) in outputs.items()]
    ).filter(F.coalesce(*[F.col(f"_c_{n}") for n in outputs]).isNotNull())

    carry = carry.withColumnsRenamed({c: f"_b_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]
    merged = local.join(F.broadcast(carry), reduce(and_, same), "left").drop(*[f"_b_{c}" for c in by])
    final = {}
    for name, (agg, _) in outputs.items():
        here, past = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if agg == "count":
            final[name] = F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))
        elif agg == "sum":
            final[name] = F.when(here.isNull(), past).when(past.isNull(), here).otherwise(here + past)
        else:
            final[name] = (F.greatest if agg == "max" else F.least)(here, past)
    drop = [f"_l_{n}" for n in outputs] + [f"_c_{n}" for n in outputs]
    return merged.withColumns(final).drop(*drop)


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based position of every row in ``order`` within ``keys``."""
    laid = lay_out(df, keys, order)
    out = running(laid, keys, order, {name: ("count", F.lit(1))})
    return out.drop("_slot")
