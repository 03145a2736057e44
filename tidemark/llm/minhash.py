"""MinHash near-duplicate detection with exact links.

1. Documents with equal word sequences collapse to a representative (one aggregate, combined map-side).
2. Each representative gets ``HASHES`` minima of universal hash functions over its word shingles. The first
   of them form ``BANDS`` bands of ``ROWS`` minima, which are buckets; documents of similarity 0.75 share none of them with probability 5e-6.
3. In every bucket each member meets the bucket's centre (a star, not all pairs). Pairs whose signatures
   agree in too few places are dropped; the others are confirmed on full shingle sets.
4. Confirmed links become connected components by alternating large-star and small-star steps.
5. Buckets that still hold several components may hide links that no star has tried. Of their members, those
   that have too few shingles in common with the others are put aside, by an exact bound. The rest meet in
   bounded blocks, across components only, by signature and then on full sets. Components are formed again.

No bucket, group or component is ever gathered whole; a popular one spreads over as many blocks as it needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidemark.llm.common import slices
from tidemark.operators.ranges import with_row_number
from tidemark.scratch import materialise

SHINGLE = 5
PERCENT = 75
HASHES, BANDS, ROWS = 256, 32, 4
#: A pair of similarity 0.75 agrees in 192 of 256 places on average, and in fewer than this with probability 2e-6.
LEAST_AGREEING = 160
SEED = 7
BLOCK = 256
#: So many ids of candidates are broadcast to the scan of the texts; more meet the texts in a shuffle join.
BROADCAST_IDS = 1_000_000
#: Shingles hashed at once.
STRIDE = 512

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PARTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@lru_cache(maxsize=2)
def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the universal hash functions ``a * x + b`` modulo 2**64."""
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, hashes, np.uint64)


def words_of(text: str) -> list[bytes]:
    """Words with small letters for A-Z: runs without ASCII white space, on which bytes split by themselves."""
    return text.encode("utf-8", "surrogatepass").translate(_UPPER).split()


def shingles(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    """The set of word shingles as sorted distinct 64-bit hashes; fewer words are one shingle, none are none."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    if len(memo) > 200_000:
        memo.clear()
    x = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh64_intdigest(w, 99)
        x[i] = h
    n = len(words) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = (h ^ x[k : k + n]) * _PARTS[k]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(found: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Sixteen bits of the minima of every hash function over a non-empty set.

    The minimum of many hashes is small, so its bits are mixed again before they are cut.
    """
    a, b = _family(hashes)
    least = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), STRIDE):
        hashed = found[None, start : start + STRIDE] * a[:, None]
        hashed += b[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    least = (least ^ (least >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    least = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (least >> np.uint64(48)).astype("<u2")


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """``100 * intersection >= percent * union`` of two non-empty sorted sets."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def signatures(texts: DataFrame) -> DataFrame:
    """``id, key, n, sig`` of every ``id, text``: digest of the word sequence, set size, minima as bytes.

    Key and minima are null for texts without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in slices(batches):
            keys, n, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text or "")
                found = shingles(words, memo)
                n.append(len(found))
                keys.append(hashlib.sha256(b" ".join(words)).digest() if words else None)
                sigs.append(signature(found).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary())], ["id", "key", "n", "sig"]
            )

    return texts.select("id", "text").mapInArrow(run, "id long, key binary, n long, sig binary")


def buckets_of(sigs: DataFrame) -> DataFrame:
    """``bucket, band, id``: one row per band of a signature."""
    size = 2 * ROWS
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    rows = sigs.select("id", "sig", band.alias("band"))
    return rows.select(F.xxhash64("band", F.substring("sig", F.col("band") * size + 1, F.lit(size))).alias("bucket"), "band", "id")


def alternate(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node of the undirected edges ``a, b``; the component is its smallest node.

    Large-star links each larger neighbour to the smallest node around, small-star each smaller one; they
    alternate until no edge changes. Each step is an aggregate and a join on the node, so a node with very
    many neighbours is a skewed join, never a list. Rounds are written to scratch.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).alias("mark")
    seen = now.agg(mark).collect()[0]["mark"]
    for _ in range(most_rounds):
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = materialise(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).filter("a <> b")
        now = materialise(small.distinct(), "small-star")
        mark_now = now.agg(mark).collect()[0]["mark"]
        if mark_now == seen:
            break
        seen = mark_now
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


@F.pandas_udf(BooleanType())
def _agree(a: pd.Series, b: pd.Series) -> pd.Series:
    """Signatures agree in enough places."""
    if not len(a):
        return pd.Series([], dtype=bool)
    x = np.frombuffer(b"".join(a), "<u2").reshape(len(a), HASHES)
    y = np.frombuffer(b"".join(b), "<u2").reshape(len(b), HASHES)
    return pd.Series((x == y).sum(axis=1) >= LEAST_AGREEING)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` that link on full shingle sets; texts are fetched for candidates only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        kept: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            mask = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if len(kept) > 100:
                    kept.clear()
                if left not in kept:
                    kept[left] = shingles(words_of(left), memo)
                mask.append(linked(kept[left], shingles(words_of(right), memo), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(mask, pa.bool_()))

    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), "wanted-ids")
    found = materialise(texts.join(_sent(wanted), F.col("id") == F.col("wanted"), "left_semi"), "wanted-texts")
    left = found.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = found.select(F.col("id").alias("b"), F.col("text").alias("right"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _sent(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast when it has few enough rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _by_signature(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("left"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("right"))
    return pairs.join(right, "b").join(left, "a").filter(_agree("left", "right")).select("a", "b")


def _sets(residual: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, component, found`` (the shingle set, sorted as unsigned numbers) of the documents ``id, component``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in slices(batches):
            found = [shingles(words_of(t), memo).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["id", "component", "found"]
            )

    wanted = _sent(residual.select(F.col("id").alias("wanted"), "component"))
    rows = texts.join(wanted, F.col("id") == F.col("wanted")).select("id", "component", "text")
    return rows.mapInArrow(run, "id long, component long, found array<long>")


def _able(sets: DataFrame, percent: int) -> DataFrame:
    """``id, size, common`` of the documents that may still link with another one of them.

    A shingle that only one of them has can be in no intersection. So an intersection has at most ``common``
    members, the shingles not its own alone, and a document with less than ``percent`` of its set in common
    links with nothing more. Near copies far from their family fall out, whatever the family's size. One
    aggregate finds the lone shingles; what they leave is subtracted.
    """
    rows = sets.select("id", F.explode("found").alias("shingle"))
    lone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("own")).filter("n = 1").groupBy("own").agg(F.count("*").alias("lone"))
    size = F.size("found").cast("long")
    able = sets.select("id", size.alias("size")).join(lone, F.col("id") == F.col("own"), "left")
    able = able.select("id", "size", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("common"))
    return materialise(able.filter(F.col("common") * 100 >= F.col("size") * percent), "able")


def _mixed(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with the number of blocks each bucket takes."""
    mixed = (
        members.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size"))
        .filter("least <> most").select(F.col("bucket").alias("mixed"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    return members.join(mixed, F.col("bucket") == F.col("mixed")).drop("mixed")


def _hidden(bands: DataFrame, components: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between different components, ``a, b``: at least one for any two that a shared bucket can show linked.

    Members of mixed buckets meet in blocks of bounded size, with signatures and full sets. A pair is looked at
    in the first band that it shares, and a member's further links to one component are not looked for.
    """
    labelled = bands.join(components, F.col("id") == F.col("node"), "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("component"))
    members = materialise(_mixed(labelled).drop("blocks"), "mixed-buckets")
    sets = materialise(_sets(materialise(members.select("id", "component").distinct(), "residual-ids"), texts), "residual-sets")
    able = _able(sets, percent)
    members = materialise(_mixed(members.join(able.select(F.col("id").alias("able")), F.col("id") == F.col("able")).drop("able")), "still-mixed")
    full = able.join(sets.select(F.col("id").alias("set_id"), "found"), F.col("id") == F.col("set_id")).drop("set_id")
    full = materialise(full.join(sigs.select(F.col("id").alias("sig_id"), "sig"), F.col("id") == F.col("sig_id")).drop("sig_id").withColumnRenamed("id", "full_id"), "able-sets")
    own = F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int")
    # Every pair of blocks of a bucket meets once; a member is sent once for each block of its bucket.
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.join(full, F.col("id") == F.col("full_id")).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "own", "id", "component", "size", "common", "found", "sig"
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids, comps, own_ = group["id"].to_numpy(), group["component"].to_numpy(), group["own"].to_numpy()
        size, common, found = group["size"].to_numpy(), group["common"].to_numpy(), group["found"].tolist()
        sig = np.frombuffer(b"".join(group["sig"]), "<u2").reshape(len(group), HASHES)
        by_band = sig[:, : BANDS * ROWS].reshape(len(group), BANDS, ROWS)
        across, band = group["i"].iloc[0] != group["j"].iloc[0], group["band"].iloc[0]
        a, b = [], []
        for k in range(len(ids) - 1):
            least = np.minimum(common[k + 1 :], common[k])
            test = (comps[k + 1 :] != comps[k]) & (100 * least >= percent * (size[k + 1 :] + size[k] - least))
            if across:
                test &= own_[k + 1 :] != own_[k]
            at = np.flatnonzero(test) + k + 1
            if not len(at):
                continue
            at = at[(sig[at] == sig[k]).sum(axis=1) >= LEAST_AGREEING]
            at = at[(by_band[at] == by_band[k]).all(axis=2).argmax(axis=1) == band]
            mine, joined = np.asarray(found[k]).view(np.uint64), set()
            for other in at.tolist():
                if comps[other] not in joined and linked(mine, np.asarray(found[other]).view(np.uint64), percent):
                    joined.add(comps[other])
                    a.append(ids[k])
                    b.append(ids[other])
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}, dtype="int64")

    return spread.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _stars(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets of two members or more, and the pairs of each bucket's centre with its other members.

    The centre is the member with the most company in all its buckets, the smallest id among equals: in a
    family of copies that is the text the copies were made from, which most of them link with.
    """
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("bucket", "_bucket")
    shared = materialise(bands.join(sizes, F.col("bucket") == F.col("_bucket")).select("bucket", "band", "id", "n"), "buckets")
    company = shared.groupBy(F.col("id").alias("_id")).agg(F.sum("n").alias("company"))
    ranked = shared.join(company, F.col("id") == F.col("_id")).select("bucket", "id", F.struct("company", (-F.col("id")).alias("other_id")).alias("rank"))
    centres = ranked.groupBy(F.col("bucket").alias("_bucket")).agg((-F.max("rank")["other_id"]).alias("centre"))
    met = shared.join(centres, F.col("bucket") == F.col("_bucket")).filter("id <> centre")
    return shared.select("bucket", "band", "id"), met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``; ids must be integers.

    ``component_id`` is the smallest id that is reachable by links, and the row that has it is ``kept``.
    Texts without words, null texts and rows with a null id link with nothing: their component is their own
    id. A text is a node of the graph, named by the smallest id that has it; rows that repeat an id follow their own
    texts, and texts of one name are one node. Further columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    every = materialise(signatures(texts), "signatures")
    sigs = every.filter("id IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.min("sig").alias("sig"))
    sigs = materialise(sigs, "representatives")

    shared, pairs = _stars(buckets_of(sigs))
    links = materialise(_confirmed(materialise(_by_signature(pairs, sigs), "star-pairs"), texts, percent), "links")
    components = materialise(alternate(links), "components")
    more = materialise(_hidden(shared, components, sigs, texts, percent), "hidden-links")
    if more.limit(1).count():
        found = components.select(F.col("node").alias("a"), F.col("component").alias("b"))  # a star for each component so far
        components = materialise(alternate(found.unionByName(more)), "components")

    groups = sigs.join(components, F.col("id") == F.col("node"), "left").select(F.col("key").alias("group_key"), F.coalesce("component", "id").alias("component"))
    # Rows that link with nothing get keys of their own, so that no task gathers them.
    alone = F.concat(F.lit("row "), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")
    own = F.when(F.col("id").isNotNull() & F.col("key").isNotNull(), F.col("key")).otherwise(alone)
    out = every.select("id", "n", own.alias("key")).join(groups, F.col("key") == F.col("group_key"), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def keep(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns: the one of the smallest id.

    Rows with a null id stay. Where ids repeat, rows are numbered by id first and each is a document of its
    own: of equal or similar rows one stays, and a text that is like no other stays whatever its id. The
    dropped ids, fewer than the documents, leave through an anti join; a hot group has distinct ids, so no
    key of it is hot.
    """
    twice = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.limit(1).count():
        return _kept(docs, percent, id_col, text_col)
    named = docs.filter(F.col(id_col).isNotNull())
    packed = named.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.struct("*").alias("whole"), F.col(text_col).alias("text"))
    numbered = materialise(with_row_number(packed, [], ["id", "h"], "row"), "numbered")
    own = _kept(numbered.select("row", "whole", "text"), percent, "row", "text").select("whole.*")
    return own.unionByName(docs.filter(F.col(id_col).isNull()))


def _kept(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """:func:`keep` where no id repeats."""
    found = near_duplicates(docs.select(id_col, text_col), percent, id_col, text_col)
    dropped = materialise(found.filter("NOT kept").select(F.col(id_col).alias("_dropped")), "dropped")
    return docs.join(_sent(dropped), F.col(id_col) == F.col("_dropped"), "left_anti")
