"""Which parts of a table may hold a key: a blocked Bloom filter for every part.

A key's hash chooses a block of ``BLOCK_BITS`` bits and ``PROBES`` bits inside it. A part has as many blocks as
its keys need at about ``BITS_A_KEY`` bits each, a power of two; a block is a row (``parts``, ``block``, ``bits``) with
the range of the part's first key column, so parts whose range a batch does not meet are passed over.
A filter never misses a key. It may name a part that does not hold it, so what it names is confirmed by a join.
Everything is built-in functions: bitmaps are aggregated per block with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The size of Spark's own bitmaps.
BLOCK_BITS = 32768
BITS_A_KEY, PROBES = 16, 4


def _hash(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def _bits(keys: Sequence[str]) -> list[Column]:
    return [F.pmod(_hash(keys, i + 1), F.lit(BLOCK_BITS)) for i in range(PROBES)]


def build(part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The filter of a part: ``blocks, block, bits, least, most``; no rows for a part without rows."""
    first = F.col(keys[0])
    n, least, most = part.agg(F.count(F.lit(1)), F.min(first), F.max(first)).first()
    blocks = 1 << max(0, (n * BITS_A_KEY // BLOCK_BITS).bit_length())
    kind = part.schema[keys[0]].dataType
    places = part.select(F.pmod(_hash(keys, 0), F.lit(blocks)).alias("block"), F.explode(F.array(*_bits(keys))).alias("at"))
    return places.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")).select(
        F.lit(blocks).cast("long").alias("blocks"), "block", "bits", F.lit(least).cast(kind).alias("least"), F.lit(most).cast(kind).alias("most"))


def _is_set(bits: str, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (at % 8).cast("int")) == 1


def candidates(new: DataFrame, index: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """The keys of ``new`` that a part may hold, with that part.

    ``index`` has the rows of :func:`build` and the column ``part``. A key meets one block of each part, so
    the join is on (blocks, block); the sizes in use are powers of two, and few. A null key meets
    nothing, as in a join.
    """
    wanted = new.select(*keys).dropna(subset=list(keys)).distinct()
    least, most = wanted.agg(F.min(keys[0]), F.max(keys[0])).first()
    near = index.filter((F.col("least") <= F.lit(most)) & (F.col("most") >= F.lit(least)))
    sizes = [r["blocks"] for r in near.select("blocks").distinct().collect()]
    if not sizes:
        return wanted.limit(0).withColumn(part, F.lit(None).cast(index.schema[part].dataType))
    probes = wanted.withColumn("_blocks", F.explode(F.array(*[F.lit(s).cast("long") for s in sorted(sizes)])))
    probes = probes.withColumn("_block", F.pmod(_hash(keys, 0), F.col("_blocks")))
    met = probes.join(near.select("blocks", "block", "bits", part), (F.col("_blocks") == F.col("blocks")) & (F.col("_block") == F.col("block")))
    for at in _bits(keys):
        met = met.filter(_is_set("bits", at))
    return met.select(*keys, part)
