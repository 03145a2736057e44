"""Incremental ingest: each source file once, each key once."""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.history import dedupe
from tidemark.operators.joins import not_seen, seen
from tidemark.scratch import materialise
from tidemark.sources import keyindex
from tidemark.sources.readers import children, exists


def ingest_new(
    spark: SparkSession, src: str, out: str, checkpoint: str, schema: T.StructType | str,
    keys: Sequence[str], order: Sequence[str], options: dict[str, str] | None = None,
) -> int:
    """Read files not yet taken, drop keys already in ``out`` or repeated, append; rows added.

    The file source's checkpoint remembers the files. Each micro-batch writes its own directory,
    overwritten if the batch is retried, so a lost driver or executor never adds rows twice. The
    directory is named by the checkpoint's own id and the epoch: a new checkpoint reads all files again
    but never writes over what an earlier one took. Only a missing ``out`` counts as an empty table.

    A filter of the keys of each directory is kept beside them (see ``keyindex``). A batch opens only the
    directories whose filter names one of its keys, and those without a filter, and only the named keys
    are looked for there; a batch of new keys hardly opens any.
    """
    name: list[str] = []
    known = threading.Event()
    added: dict[int, int] = {}

    def take(batch: DataFrame, epoch: int) -> None:
        known.wait()
        own = f"{name[0]}-{epoch}"
        fresh = dedupe(batch, keys, order)
        old = _known_keys(spark, batch, out, own, keys)
        if old is not None:
            fresh = not_seen(fresh, old, keys)
        path = f"{out}/epoch={own}"
        fresh.write.mode("overwrite").parquet(path)
        written = spark.read.schema(fresh.schema).parquet(path)
        keyindex.build(written, keys).write.mode("overwrite").parquet(f"{_index(out)}/epoch={own}")
        added[epoch] = written.count()

    reader = spark.readStream.schema(schema).options(**(options or {}))
    query = (
        reader.parquet(src).writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    name.append(query.id)
    known.set()
    query.awaitTermination()
    return sum(added.values())


def _index(out: str) -> str:
    """Readers of the table pass over names that start with an underscore."""
    return f"{out}/_keys"


def _known_keys(spark: SparkSession, batch: DataFrame, out: str, own: str, keys: Sequence[str]) -> DataFrame | None:
    """The keys of ``batch`` that other directories of ``out`` hold, or None."""
    found = [p for p in children(spark, out) if not p.startswith(("_", "."))]
    if foreign := [p for p in found if not p.startswith("epoch=")]:
        raise ValueError(f"{out} is not a table by epoch: it holds {foreign[0]}")
    parts = {p for p in found if p != f"epoch={own}"}
    indexed = {p for p in parts if exists(spark, f"{_index(out)}/{p}/_SUCCESS")}
    named = None
    opened = parts - indexed
    if indexed:
        index = spark.read.option("basePath", _index(out)).parquet(*[f"{_index(out)}/{p}" for p in sorted(indexed)])
        named = materialise(keyindex.candidates(batch, index, keys, "epoch"), "candidates")
        opened |= {f"epoch={r['epoch']}" for r in named.select("epoch").distinct().collect()}  # one row a directory
    if not opened:
        return None
    old = spark.read.option("basePath", out).parquet(*[f"{out}/{p}" for p in sorted(opened)]).select(*keys)
    if named is not None and not parts - indexed:
        old = seen(old, named.select(*keys).distinct(), keys)
    return materialise(old.distinct(), "known-keys")
