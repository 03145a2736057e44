"""Small frames with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (3, ""),
    (4, None),
    (None, "a row without an id"),
    (5, "  \n\t "),
    (6, "word"),
    (7, "x" * 3000),
    (8, "again and again " * 4000),
    (9, "İstanbul ΣΑΣ ﬁ 😀 中文字 ١٢٣ \x1c \x85 　 'll don't <|endoftext|> <|startoftext|>"),
]
#: Names that operators use inside.
CLASHING = ["id", "key", "n", "sig", "score", "failed", "kept", "n_words", "length", "bucket", "rank", "n_tokens"]


def odd_docs(spark, rows=ODD):
    kinds = "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHING)
    return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], kinds)


def empty_docs(spark):
    return odd_docs(spark, [])
