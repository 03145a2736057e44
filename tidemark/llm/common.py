"""Helpers shared by the operators: table access, Arrow batches, bounded memo tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows turned into Python objects at once; texts may be long, so Arrow batches are read in slices.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``SLICE_ROWS``, so that few Python strings live at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


class Memo(dict):
    """A memo table of bounded size in two generations: when the young one is full it becomes the old one.

    Entries of the old one that are asked for again become young, so what is in use stays. Keys of
    ``longest`` or more characters are computed but not kept. Only speed depends on what it holds, never a result.
    """

    def __init__(self, compute: Callable, limit: int, longest: int = 100):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.compute(key)
            if len(key) >= self.longest:
                return value
        if len(self) >= self.limit // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Characters for which lower-casing and NFC act on each character alone, white space is the blank and
#: the line feed, and every Unicode version agrees on letters and digits: printable ASCII and the
#: letters of Latin-1. Texts with any other character take the slower, general path.
PLAIN = frozenset("\n" + "".join(map(chr, range(0x20, 0x7F))) + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)))


def is_plain(text: str) -> bool:
    return PLAIN.issuperset(text)
