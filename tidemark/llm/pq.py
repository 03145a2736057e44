"""Product quantisation of integer vectors, with assignments pruned by fixed pivots.

Vectors are cut into consecutive parts; every part position has a codebook, refined by rounds of
assignment and componentwise floored means. Assignments are exact integer arithmetic.

**Pivots.** Each part position keeps a few fixed points, chosen among the first entries, each farthest from
those before it. Distances of all parts to their pivots are computed once and stored with the parts.
In a round only the distances between pivots and entries are new: by the triangle inequality
``|d(part, pivot) - d(pivot, entry)|`` bounds ``d(part, entry)`` from below. A part meets the entries in order
of their bounds and stops at the first whose bound exceeds the best distance found; only those met are
evaluated. Bounds are lowered by the rounding error of their arithmetic, so no nearest entry is missed.

A round is one map over the stored parts and one small aggregate: a task sends at most
``parts * entries * part length`` sums, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import materialise

PARTS, ENTRIES, ROUNDS, PIVOTS = 8, 16, 6, 4
SCALE = 4096
#: Components reach this far from zero at most: squared distances then fit 64 bits. Others raise an error.
REACH = 1 << 26
#: Relative error of a computed distance, with room.
SLACK = 1e-9
#: Vectors evaluated at once.
STRIDE = 4096


def usable(vector: str) -> Column:
    """Vectors that take part: not null, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def integers(vector: str, scale: int = SCALE) -> Column:
    """Components as floor(scale * x)."""

    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(y) <= REACH, y.cast("int")).otherwise(
            F.raise_error(F.lit(f"component beyond {REACH // scale}")).cast("int"))

    return F.transform(vector, one)


def distances(parts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of each row of ``parts`` to each of ``points``, from exact squares."""
    return np.sqrt(np.stack([squares(parts, p) for p in points], axis=1).astype(np.float64))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def choose_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the entries, each farthest from those before it, the first entry first."""
    chosen, least = [0], squares(entries, entries[0])
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squares(entries, entries[chosen[-1]]))
    return entries[chosen]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each part (ties to the lower index), its squared distance, and how many were evaluated."""
    between = distances(entries, pivots)
    bound = np.zeros((len(parts), len(entries)))
    for j in range(len(pivots)):
        a, b = to_pivots[:, j, None], between[None, :, j]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(parts), np.iinfo(np.int64).max)
    found = np.full(len(parts), len(entries))
    rows, evaluated = np.arange(len(parts)), 0
    for k in range(len(entries)):
        entry = order[rows, k]
        low = bound[rows, entry]
        open_ = low * low <= best[rows]
        rows, entry = rows[open_], entry[open_]
        if not len(rows):
            break
        evaluated += len(rows)
        square = squares(parts[rows], entries[entry])
        better = (square < best[rows]) | ((square == best[rows]) & (entry < found[rows]))
        best[rows[better]], found[rows[better]] = square[better], entry[better]
    return found, best, evaluated


@dataclass(frozen=True)
class Codebooks:
    """Entries and pivots by part position: integer arrays of shape (parts, entries, part length)."""

    entries: np.ndarray
    pivots: np.ndarray

    @property
    def sha256(self) -> str:
        """Digest of the components as decimals by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def measure(self, vectors: np.ndarray) -> np.ndarray:
        """Distances to the pivots, of shape (rows, parts, pivots)."""
        return np.stack([distances(vectors[:, p], self.pivots[p]) for p in range(len(self.pivots))], axis=1)

    def assign(self, vectors: np.ndarray, measured: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Codes and squared distances, each of shape (rows, parts), and the number of evaluations."""
        each = [nearest(vectors[:, p], measured[:, p], self.pivots[p], self.entries[p]) for p in range(len(self.entries))]
        return np.stack([e[0] for e in each], axis=1), np.stack([e[1] for e in each], axis=1), sum(e[2] for e in each)


def _matrix(column: pa.Array, *shape: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), *shape)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STRIDE):
            yield batch.slice(at, STRIDE)


def _with_distances(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (id, label, v) with the distances to the pivots, computed once."""
    parts, _, length = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            vectors = _matrix(batch.column(2), parts, length).astype(np.int64)
            far = books.measure(vectors).reshape(batch.num_rows, -1)
            offsets = pa.array(np.arange(batch.num_rows + 1) * far.shape[1], pa.int32())
            column = pa.ListArray.from_arrays(offsets, pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], ["id", "label", "v", "far"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, far array<double>")


def _sums(stored: DataFrame, books: Codebooks) -> DataFrame:
    """Sum and count of the parts of each entry, by part, entry and position; one row each."""
    parts, entries, length = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64)
        for batch in _pieces(batches):
            vectors = _matrix(batch.column(0), parts, length).astype(np.int64)
            codes, _, _ = books.assign(vectors, _matrix(batch.column(1), parts, books.pivots.shape[1]))
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(total[p], codes[:, p], vectors[:, p])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, length)), pa.array(np.repeat(e, length)), pa.array(np.tile(np.arange(length), len(p))),
             pa.array(total[p, e].ravel()), pa.array(np.repeat(count[p, e], length))],
            ["part", "entry", "pos", "total", "n"],
        )

    partial = stored.select("v", "far").mapInArrow(run, "part long, entry long, pos long, total long, n long")
    return partial.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _codes(stored: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (id, label, code, error)."""
    parts, _, length = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            vectors = _matrix(batch.column(2), parts, length).astype(np.int64)
            codes, error, _ = books.assign(vectors, _matrix(batch.column(3), parts, books.pivots.shape[1]))
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error.sum(axis=1))], ["id", "label", "code", "error"]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema if f.name in ("id", "label"))
    return stored.mapInArrow(run, f"{kinds}, code string, error long")


def train(stored: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Refine the entries: each becomes the floored mean of its parts; unused entries stay."""
    for _ in range(rounds):
        entries = books.entries.copy()
        for r in _sums(stored, books).collect():  # at most parts * entries * part length rows
            entries[r["part"], r["entry"], r["pos"]] = r["total"] // r["n"]
        books = Codebooks(entries, books.pivots)
    return books


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS, scale: int = SCALE,
) -> DataFrame:
    """Codes of all usable vectors: the id, ``code`` (two hexadecimal digits a part), ``error``, ``label_error``,
    ``codebooks_sha256``.

    One row per usable row, repeated ids included; vectors that are null or hold null or non-finite
    components take no part. The first entries are those of the ``entries`` smallest distinct ids (of rows
    that share an id, the smallest vector); rows without an id start no entry, unless no row has one. With
    fewer ids there are fewer entries. ``label_error`` sums the error over equal labels, nulls together. Vectors of
    different lengths, lengths that ``parts`` does not divide, and components beyond ``REACH`` raise an
    error. Further columns are ignored, whatever their names; an empty table gives an empty result. At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hexadecimal digits: 1 to 256 entries")
    rows = vectors.filter(usable(vector_col)).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), integers(vector_col, scale).alias("v"))
    ids = [r["id"] for r in rows.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    given = [i for i in ids if i is not None]
    first = rows.filter(F.col("id").isin(given) if given else F.col("id").isNull()).groupBy("id").agg(F.min("v").alias("v"))
    named = [r["v"] for r in first.orderBy("id").collect()] if ids else []
    if not named:
        digest = hashlib.sha256(b"").hexdigest()
        out = vectors.limit(0).select(id_col, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return out.withColumn("codebooks_sha256", F.lit(digest))
    size = len(named[0])
    if any(len(v) != size for v in named):
        raise ValueError(f"a vector has not {size} components")
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} parts")
    same = F.when(F.size("v") == size, F.col("v")).otherwise(
        F.raise_error(F.lit(f"a vector has not {size} components")).cast("array<int>"))
    start = np.array(named, np.int64).reshape(len(named), parts, size // parts).transpose(1, 0, 2)
    books = Codebooks(start, np.stack([choose_pivots(e, pivots) for e in start]))
    stored = materialise(_with_distances(rows.withColumn("v", same), books), "parts")
    books = train(stored, books, rounds)
    coded = materialise(_codes(stored, books), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
