"""Tables in key buckets that are rewritten bucket by bucket.

A row lies in the bucket of its key's hash. A write puts rows under a folder of its own, ``data/<folder>/_bucket=B``; a
manifest names the folder in force for each bucket, and the highest manifest is the table. A change reads and rewrites
only the buckets its keys fall into, and then writes a new manifest. Until that is there, readers see the table as
it was. Before the manifest its writer claims the turn with an exclusively created file, so of two changes
made from one version the second fails; a claim left by a writer that died is given up by ``release``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.history import merge, scd2_apply, snapshot
from tidemark.sources.readers import children, create_new, delete, exists

CHANGE = "change"


class BucketedTable:
    """A table under ``path`` with ``buckets`` buckets of ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Finished manifests, oldest first."""
        names = children(self.spark, f"{self.path}/manifest")
        return sorted(int(n.removeprefix("v")) for n in names if exists(self.spark, f"{self.path}/manifest/{n}/_SUCCESS"))

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Folder of each bucket that has rows; one small row a bucket."""
        found = self.versions()
        if not found:
            raise ValueError(f"no table at {self.path}")
        rows = self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/manifest/v{found[-1] if version is None else version}")
        return {r["bucket"]: r["folder"] for r in rows.collect()}

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, now or as of a version, or some buckets of it."""
        held = self.manifest(version)
        return self._read(held if buckets is None else {b: held[b] for b in buckets if b in held})

    def _read(self, wanted: dict[int, str], more: str = "") -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        if not wanted:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema if not more else f"{schema.toDDL()}, {more}")
        return rows.parquet(*[f"{self.path}/data/{f}/_bucket={b}" for b, f in sorted(wanted.items())])

    def create(self, rows: DataFrame) -> None:
        """The first version."""
        if self.versions():
            raise ValueError(f"there is a table at {self.path}")
        if CHANGE in rows.columns:
            raise ValueError(f"a column cannot be called {CHANGE}")
        rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")
        folder, staged = self._stage(rows)
        self._commit(0, {b: folder for b in staged})

    def _stage(self, rows: DataFrame) -> tuple[str, set[int]]:
        """Write rows under a new folder; its name and the buckets that got some."""
        folder = uuid.uuid4().hex
        path = f"{self.path}/data/{folder}"
        rows.withColumn("_bucket", self.bucket()).hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(path)
        return folder, {int(n.removeprefix("_bucket=")) for n in children(self.spark, path) if n.startswith("_bucket=")}

    def _commit(self, version: int, now: dict[int, str]) -> None:
        if not create_new(self.spark, f"{self.path}/claims/v{version}"):
            raise RuntimeError(f"version {version} of {self.path} is written by another")
        rows = self.spark.createDataFrame(sorted(now.items()), "bucket int, folder string").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/manifest/v{version}")

    def release(self) -> None:
        """Give up the claim of a writer that died before its manifest was written."""
        finished = set(self.versions())
        for name in children(self.spark, f"{self.path}/claims"):
            if int(name.removeprefix("v")) not in finished:
                delete(self.spark, f"{self.path}/claims/{name}")

    def rewrite(self, source: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> dict[int, str | None]:
        """Put ``change(old rows, source)`` in place of the rows in the buckets that the keys of ``source`` fall into.

        Buckets whose rows come out as they were keep their files; if all do, there is no new version.
        Returns the buckets that changed with their new folder, None if they are empty now. ``change`` must leave
        keys in their buckets.
        """
        version, held = self.versions()[-1] + 1, self.manifest()
        touched = {r["b"] for r in source.select(self.bucket().alias("b")).distinct().collect()}  # at most all buckets
        if not touched:
            return {}
        before = {b: f for b, f in held.items() if b in touched}
        folder, staged = self._stage(change(self._read(before), source))
        if stray := staged - touched:
            delete(self.spark, f"{self.path}/data/{folder}")
            raise ValueError(f"rows left their buckets for {sorted(stray)[:5]}")
        was, now = self._digests(before), self._digests({b: folder for b in staged})
        changed: dict[int, str | None] = {b: folder for b in staged if now[b] != was.get(b)}
        changed |= {b: None for b in before if b not in staged}
        for b in staged - set(changed):
            delete(self.spark, f"{self.path}/data/{folder}/_bucket={b}")
        if not changed:
            delete(self.spark, f"{self.path}/data/{folder}")
            return {}
        self._commit(version, {b: f for b, f in (held | changed).items() if f is not None})
        return changed

    def _digests(self, wanted: dict[int, str]) -> dict[int, tuple]:
        """Rows and order-free digests of each bucket: sums of two hashes of whole rows."""
        rows = self._read(wanted)
        sums = [F.sum(F.xxhash64(F.lit(seed), *rows.columns).cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]
        found = rows.groupBy(self.bucket().alias("b")).agg(F.count(F.lit(1)).alias("n"), *sums)
        return {r["b"]: (r["n"], r["s1"], r["s2"]) for r in found.collect()}

    def vacuum(self, keep: int = 1) -> None:
        """Delete the data and manifests that the newest ``keep`` versions do not need; no writer may be at work."""
        found = self.versions()
        needed = {(f, b) for n in found[-keep:] for b, f in self.manifest(n).items()}
        for n in found[:-keep]:
            delete(self.spark, f"{self.path}/manifest/v{n}")
        for folder in children(self.spark, f"{self.path}/data"):
            own = [int(n.removeprefix("_bucket=")) for n in children(self.spark, f"{self.path}/data/{folder}") if n.startswith("_bucket=")]
            gone = [b for b in own if (folder, b) not in needed]
            for place in [folder] if len(gone) == len(own) else [f"{folder}/_bucket={b}" for b in gone]:
                delete(self.spark, f"{self.path}/data/{place}")

    def merge(self, source: DataFrame, condition: Column | None = None) -> DataFrame:
        """Upsert in place (see ``history.merge``): rows per kind of change in the touched buckets."""
        changed = self.rewrite(source, lambda old, new: merge(old, new, self.keys, condition))
        rows = self._read(changed, f"{CHANGE} string")
        return rows.groupBy(CHANGE).agg(F.count(F.lit(1)).alias("rows")) if changed else self.spark.createDataFrame([], f"{CHANGE} string, rows bigint")

    def scd2(self, changes: DataFrame, tracked: Sequence[str]) -> dict[int, str | None]:
        """Close and open versions in place (see ``history.scd2_apply``); the table's key is the dimension's."""
        return self.rewrite(changes, lambda old, new: scd2_apply(old, new, self.keys[0], tracked))

    def snapshot(self, source: DataFrame, check: Sequence[str], as_of: str) -> dict[int, str | None]:
        """Compare with a full or partial source in place (see ``history.snapshot``)."""
        return self.rewrite(source, lambda old, new: snapshot(old, new, self.keys[0], check, as_of))
