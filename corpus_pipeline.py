"""The corpus pipeline over ``documents``: rules, toxicity, near duplicates, packing.

Each stage takes what its predecessor kept; all but the last return the columns of ``documents``. Stages
act on the text of whole documents; what they learn, they learn from the labelled documents of ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, packing, rules, toxicity
from tidemark.llm.common import table
from tidemark.scratch import materialise

#: Documents at or above this score go.
TOXIC_FROM = 0.5
TOKENIZER = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects. Null and empty texts are rejected (too few words)."""
    return rules.keep(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC_FROM`` by a lexicon learned from the labels."""
    return toxicity.keep(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; of rows that repeat it, one."""
    return minhash.keep(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; see ``op3`` for the columns."""
    return packing.pack_documents(docs, *map(public_tokenizers.path, TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]
#: Stages run outside SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
