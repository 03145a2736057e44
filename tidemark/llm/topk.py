"""Exact top-k search by inner product over norm buckets.

Candidates are sorted by length (norm) and cut into buckets of equal row counts. For a query with k
results so far, the k-th score is a threshold, and in a bucket whose longest vector has length ``l`` it
becomes a local threshold on the cosine: ``threshold / (|query| * l)``. Above one, the bucket cannot hold a
better result. Otherwise each bucket picks its pruning: a high cosine threshold bounds every single
coordinate (coordinate pruning), a low one only says how long a candidate must be (length pruning). What
remains is verified by the exact integer inner product.

Queries travel in blocks and meet buckets in blocks; a task holds one block of each, whatever the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import materialise

K = 20
BUCKET_ROWS = 4_096
QUERY_ROWS = 1_024
#: Cosine thresholds from here on prune by coordinates, lower ones by length.
COORDINATE_FROM = 0.45
#: Coordinates of the query, by size, whose feasible regions are tested.
FOCUS = 4
#: The exponent of two by which components are scaled before they are floored.
SCALE = 64.0
#: Float arithmetic on integers is exact below this.
EXACT = float(1 << 52)


def quantised(vector: str, scale: float = SCALE) -> Column:
    """``floor(scale * x)`` of every component as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: str) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of equal width; missing components of shorter vectors count as zero."""
    width = max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


class Bucket:
    """Candidates of one bucket, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        order = np.lexsort((ids, -norms))
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.real = self.vectors.astype(float)
        self.direction = self.real / np.maximum(self.norms, 1e-300)[:, None]
        self.longest = float(self.norms[0]) if len(ids) else 0.0
        self.repeats = len(np.unique(ids)) < len(ids)

    def candidates(self, query: np.ndarray, norm: float, threshold: float) -> np.ndarray:
        """Positions that may score at least ``threshold``; none is left out that does."""
        if threshold <= 0 or norm == 0 or self.longest == 0:
            return np.arange(len(self.ids))
        local = threshold / (norm * self.longest) * (1 - 1e-9)
        if local > 1:
            return np.arange(0)
        reach = int(np.searchsorted(-self.norms, -(threshold / norm) * (1 - 1e-9), side="right"))
        if local < COORDINATE_FROM:
            return np.arange(reach)
        found = np.arange(reach)
        unit = query / norm
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            if not len(found):
                break
            # cos >= local leaves coordinate f of a unit candidate within unit[f] * local +- slack
            slack = np.sqrt(max(0.0, 1 - local * local) * max(0.0, 1 - unit[f] ** 2)) + 1e-9
            x = self.direction[found, f]
            low = unit[f] * local - slack if unit[f] * local - slack > -1 else -1.0
            high = unit[f] * local + slack
            # the region widens upwards up to one when the coordinate itself exceeds the threshold's share
            if unit[f] >= local:
                high = 1.0
            if unit[f] <= -local:
                low = -1.0
            found = found[(x >= low - 1e-9) & (x <= high + 1e-9)]
        return found


def _exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as Python or 64-bit integers; raises where one does not fit into a long."""
    limit = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if limit < EXACT:
        return np.rint(vectors.astype(float) @ query.astype(float)).astype(np.int64)
    scores = vectors.astype(object) @ query.astype(object)
    if len(scores) and max(map(abs, scores)) >= 1 << 63:
        raise OverflowError("an inner product does not fit into a long")
    return scores.astype(np.int64)


def search_block(queries: pd.DataFrame, bucket: Bucket, k: int) -> tuple[list, list, list]:
    """Best ``k`` ids of the bucket for each query, repeated ones once: query ids, candidate ids and scores."""
    out: tuple[list, list, list] = ([], [], [])
    if not len(queries) or not len(bucket.ids):
        return out
    q = _matrix(queries["v"])
    width = max(q.shape[1], bucket.vectors.shape[1])
    q, vectors = _widened(q, width), _widened(bucket.vectors, width)
    if bucket.direction.shape[1] < width:
        bucket.direction = _widened(bucket.direction, width)
    norms = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    for own, row, norm, known in zip(queries["vec_id"].tolist(), q, norms, queries["threshold"].tolist()):
        threshold = known if known is not None and known == known else 0
        found = bucket.candidates(row, float(norm), float(threshold))
        if not len(found):
            continue
        scores, ids = _exact_scores(vectors[found], row), bucket.ids[found]
        keep = ids != own
        if threshold > 0:
            keep &= scores >= threshold
        scores, ids = scores[keep], ids[keep]
        if bucket.repeats and len(ids):  # the best score of each id
            order = np.lexsort((-scores, ids))
            order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]]
            scores, ids = scores[order], ids[order]
        if len(ids) > k:  # everything that ties with the k-th stays until the sort
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[scores >= least], ids[scores >= least]
        order = np.lexsort((ids, -scores))[:k]
        out[0].extend([own] * len(order))
        out[1].extend(ids[order].tolist())
        out[2].extend(scores[order].tolist())
    return out


_HITS = "query_id long, vec_id long, score long"


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each query; a pair counts once. Spark cuts to k before it shuffles."""
    pairs = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
    bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query row.

    Ties go to the smaller id. A query meets every row but those with its own id. Rows whose id or vector
    is null, or whose vector holds null or non-finite components, take no part; empty vectors do, with
    scores of zero, and so do shorter ones, whose missing components are zero. Rows that repeat an id
    count once for a query, with their best score. Fewer than ``k`` candidates give fewer rows; an empty
    table gives none. Further columns are ignored. Scores beyond a long raise an error.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    )
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = materialise(rows.withColumn("norm", F.sqrt(square)), "vectors")
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Equal lengths are ordered by id, so a length that a third of the rows share still fills many buckets.
    buckets = materialise(
        rows.repartitionByRange(-(-n // bucket_rows), F.desc("norm"), "vec_id").withColumn("bucket", F.spark_partition_id()), "buckets"
    )
    longest = buckets.groupBy("bucket").agg(F.max("norm").alias("longest"), F.count_distinct("vec_id").alias("ids"))
    first = longest.filter(F.col("ids") > k).agg(F.min("bucket").alias("b")).collect()[0]["b"]
    asked_rows = buckets.filter("is_query")
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, -(-asked_rows.count() // query_rows))))
    queries = asked_rows.select("vec_id", "v", "norm", block.alias("block")).distinct().withColumn("threshold", F.lit(None).cast("long"))

    def probe(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bucket = Bucket(right["c_id"].to_numpy(np.int64), _matrix(right["c_v"]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), search_block(left, bucket, k))))

    def meet(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """Search the listed (block, bucket) pairs; both sides of a pair are bounded."""
        left = asked.join(pairs, "block").select("block", "bucket", "vec_id", "v", "threshold")
        right = buckets.join(pairs, "bucket").select("block", "bucket", "vec_id", "v").toDF("c_block", "c_bucket", "c_id", "c_v")
        return left.groupBy("block", "bucket").cogroup(right.groupBy("c_block", "c_bucket")).applyInPandas(probe, _HITS)

    every_block = queries.select("block").distinct()
    if first is None:  # no bucket alone can fill k places: everything is searched
        hits = meet(queries, every_block.join(longest.select("bucket")))
        return _best(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    start = materialise(meet(queries, every_block.withColumn("bucket", F.lit(first))), "first-hits")
    # The score of the k-th id of the first bucket is a threshold only when there are k ids.
    kth = _best(start, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    asked = materialise(queries.drop("threshold").join(kth, "vec_id", "left").withColumnRenamed("kth", "threshold"), "queries")
    # A block meets a bucket when one of its queries could score its threshold there.
    need = F.when(F.coalesce("threshold", F.lit(0)) <= 0, F.lit(0.0)).when(F.col("norm") == 0, F.lit(0.0)).otherwise(F.col("threshold") / F.col("norm"))
    reach = asked.groupBy("block").agg(F.min(need).alias("least"))
    pairs = reach.join(longest.filter(F.col("bucket") != first), F.col("longest") * (1 + 1e-9) >= F.col("least")).select("block", "bucket")
    hits = start.unionByName(meet(asked, pairs))
    return _best(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
