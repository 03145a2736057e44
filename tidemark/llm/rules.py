"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps, next to the measurements, one number whose
bit *i* says that rule *i* failed. A policy is a mask of the rules that reject; policies are versioned,
and applying another one, or asking what each rule contributes, reads the ledger and no text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_loud_words", "n_exclaims", "n_stutters"]

#: Rule i of the list is bit i of the ledger: name and the condition, in SQL, under which it fails.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("loud_words", "100 * n_loud_words > 40 * n_words"),
    ("exclamations", "100 * n_exclaims > 40 * n_words"),
    ("stutter", "100 * n_stutters > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
#: Versioned policies: which rules reject. A published version never changes.
POLICIES: dict[str, int] = {"base": BASE, "1": (1 << len(RULES)) - 1}
CURRENT = "1"


def repeated_words(ids: np.ndarray, size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur at least twice; ``ids`` stand for the words.

    Windows are numbered pair by pair, so equal numbers mean equal windows, without hashing.
    """
    if len(ids) < size:
        return 0
    n = len(ids)
    if n < 4096:  # five numbers of twelve bits fit into one
        code = np.zeros(n - size + 1, np.int64)
        for k in range(size):
            code = code << 12 | ids[k : n - size + 1 + k]
    else:
        code = ids
        for k in range(1, size):
            code = np.unique(code[: n - k] * n + ids[k:], return_inverse=True)[1]
    ranked = np.sort(code)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(code, twice))
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``.

    Words are runs without ASCII white space, on which bytes split by themselves. Loud words hold a
    capital and no small letter A-Z; exclamations are words that hold ``!!``;
    stutters are words equal to the one before.
    """
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, joined = len(words), b"".join(words)
    lines = [line for line in text.split("\n") if line.strip("\t\n\v\f\r ")]
    index: dict[bytes, int] = {}
    ids = np.fromiter(map(index.setdefault, words, count()), np.int64, n)
    exclaims = sum(b"!!" in w for w in words) if b"!!" in joined else 0
    return (
        n, len(text) - len(raw) + len(joined), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(ids), len(lines), sum(map(bytes.isupper, words)), exclaims,
        int(np.count_nonzero(ids[1:] == ids[:-1])),
    )


def ledger(docs: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, every measurement and ``failed``, the mask of failed rules: one row per row of ``docs``.

    Null and empty texts have no words, and so fail ``too_few_words`` only. Repeated rows and null ids
    are kept; further columns are ignored; an empty table gives an empty ledger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [measure(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], ["id", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = sum((F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, test) in enumerate(rules)), F.lit(0))
    return rows.withColumn("failed", failed.cast("long")).withColumnRenamed("id", id_col)


def apply_policy(kept: DataFrame, version: str = CURRENT, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """Add ``kept``: no rule of the policy failed. Reads the mask only."""
    return kept.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policies[version]).cast("long")) == 0)


def keep(docs: DataFrame, version: str = CURRENT, rules: list[tuple[str, str]] = RULES, policies: Mapping[str, int] = POLICIES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the policy keeps.

    Texts are measured in the scan, next to the columns, so no join brings them together again. Repeated
    rows are judged alike; columns named like measurements stay as they are.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema.names.index(text_col)
        for batch in slices(batches):
            rows = list(zip(*(measure(t or "") for t in batch.column(at).to_pylist())))
            made = [pa.array(c, pa.int64()) for c in rows] if rows else [pa.array([], pa.int64())] * len(MEASURES)
            packed = pa.StructArray.from_arrays(made, MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], [*(f"c{i}" for i in range(batch.num_columns)), "m"])

    columns = [f.dataType.simpleString() for f in schema]
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    kinds = ", ".join([*(f"c{i} {k}" for i, k in enumerate(columns)), "m struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">"])
    measured = plain.mapInArrow(run, kinds).select("*", "m.*")
    failed = sum((F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, test) in enumerate(rules)), F.lit(0))
    passed = failed.bitwiseAND(F.lit(policies[version])) == 0
    return measured.filter(passed).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(schema.names)])


def ablations(kept: DataFrame, version: str = CURRENT, rules: list[tuple[str, str]] = RULES, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """Per rule of a policy: ``rule, failing, only_this`` (documents kept if the rule were dropped).

    The ledger is first reduced to its distinct masks, at most two to the power of the number of rules,
    before the shuffle; each rule is then a bit test on those.
    """
    policy = policies[version]
    masks = kept.groupBy(F.col("failed").bitwiseAND(F.lit(policy).cast("long")).alias("mask")).agg(F.count("*").alias("n"))
    used = [(name, 1 << i) for i, (name, _) in enumerate(rules) if policy >> i & 1]
    out = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in used])
    rows = masks.withColumn("r", F.explode(out))
    hit = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failing"),
        F.coalesce(F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("only_this"),
    )


def summary(kept: DataFrame, by: str | None = None) -> DataFrame:
    """Which rules failed anywhere and everywhere (``any_failed``, ``all_failed``), in total or per key."""
    aggs = [F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"), F.count("*").alias("n")]
    return kept.groupBy(by).agg(*aggs) if by else kept.agg(*aggs)
