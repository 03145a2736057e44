"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of measurements of its text. A preferred document beats another
with probability ``1 / (1 + exp(strength of the other - own strength))``; the weights minimise the logistic
loss on the feature differences of preference pairs. The cut between good and poor is a quantile of the
strengths: the share of poor documents among the labelled ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import slices
from tidemark.llm.rules import measure
from tidemark.llm.toxicity import training_rows

#: Documented bounds of what is fitted: labelled rows read, and opponents drawn for each poor document.
SAMPLE_ROWS = 8_000
OPPONENTS = 16
RIDGE = 1e-3
#: The score at the cut.
CUT = 0.3

FEATURES = [
    "symbols", "repeats", "duplicate_lines", "loud", "exclaims", "stutters", "length", "word_length", "long_words", "variety",
    "digits", "marks", "very_short", "words_per_line",
]


def features(text: str) -> list[float]:
    """Measurements of one whole text, each between 0 and about 3; an empty text is all zeros but ``very_short``."""
    n, chars, symbols, dup, repeats, lines, loud, exclaims, stutters = measure(text)
    if not n:
        return [0.0] * 12 + [1.0, 0.0]
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    root = lambda part, of: min(2.0, (part / max(of, 1)) ** 0.5)
    return [
        root(symbols, n), repeats / n, dup / max(lines, 1), loud / n, root(exclaims, n), stutters / n, np.log10(n + 1) / 2,
        min(chars / n, 30) / 10, root(sum(len(w) > 25 for w in words), n), len(set(words)) / n,
        root(len(raw) - len(raw.translate(None, b"0123456789")), len(raw)),
        root(len(raw) - len(raw.translate(None, b"!?;:=+_~^@/\\{}[]()\"'")), len(raw)),
        float(n < 3), np.log10(n / max(lines, 1) + 1) / 2,
    ]


@dataclass
class Ranking:
    """Weights, and the strength at which the score is ``CUT``."""

    weights: tuple[float, ...] = (0.0,) * len(FEATURES)
    threshold: float = 0.0

    def score(self, x: list[float]) -> float:
        z = float(np.dot(self.weights, x)) - self.threshold + np.log(CUT / (1 - CUT))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def bradley_terry(differences: np.ndarray, ridge: float = RIDGE, rounds: int = 100) -> np.ndarray:
    """Weights with the least mean of ``log(1 + exp(-difference @ weights))`` plus ridge, by Newton steps."""
    w = np.zeros(differences.shape[1])
    n = len(differences)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))
        gradient = -(differences.T @ p) / n + ridge * w
        hessian = (differences * (p * (1 - p))[:, None]).T @ differences / n + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def preferences(y: np.ndarray, opponents: int = OPPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(preferred, other) positions: every poor document meets good ones, every good one a poor one at least."""
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    k = max(opponents, -(-len(good) // len(poor)))
    other = np.repeat(poor, k)
    return good[np.arange(len(other)) % len(good)], other


def rank(x: np.ndarray, y: np.ndarray) -> Ranking:
    """Fit on labelled feature rows; with labels of one kind only, every score is ``CUT``."""
    if len(set(y.tolist())) < 2:
        return Ranking()
    better, worse = preferences(y)
    w = bradley_terry(x[better] - x[worse])
    strengths = np.sort(x @ w)
    k = int(np.count_nonzero(y == 0))
    return Ranking(tuple(float(v) for v in w), float((strengths[k - 1] + strengths[k]) / 2))


def _features(frame: DataFrame, key: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["key", "x"])

    return frame.select(key, "text").mapInArrow(run, f"key {kind}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Ranking:
    """Learn the ranking from at most ``rows`` labelled documents outside the held-out fifth.

    Features are computed in Spark; fourteen numbers per sampled document reach the driver.
    """
    got = _features(training_rows(docs, labels, label, rows), "y", "int").collect()
    if not got:
        return Ranking()
    x, y = np.array([r["x"] for r in got]), np.array([r["key"] for r in got])
    order = np.lexsort((*x.T, y))  # the result does not depend on the order in which rows arrive
    return rank(x[order], y[order])


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` (0 to 1) of every whole text; good is ``score >= CUT``.

    One row per row of ``docs``, repeated rows and null ids included; null and empty texts are scored
    as texts without words. Only the text enters the score. Further columns are ignored; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = [ranking.score(features(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
