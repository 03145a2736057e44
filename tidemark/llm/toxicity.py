"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

**Folding** undoes disguises: look-alike letters of other scripts and full-width forms become Latin,
accents and invisible characters go, upper case goes, and digits or signs inside a word become the
letters they stand for. A disguised run may be read in several ways: 1 as i or as l, and digits and signs
at its ends or in rows as letters or as separators. A match counts in any reading.

**The lexicon** holds words and word beginnings with a weight, the log-odds of a toxic label among
labelled documents that have them. A longer entry is kept only where it says more than a shorter
one that it begins with. **Exception phrases** are words, word pairs and triples that an entry matches but
that stand in clean documents only; a match inside one does not count.

**The score** is logistic in the weighted matches, as a sum, per length, and by distinct entries.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.scratch import materialise

#: Documented bound of what is fitted: labelled rows read.
SAMPLE_ROWS = 16_000
#: An entry needs so many toxic documents, this weight and this log-likelihood ratio against chance (there
#: are very many candidates); an exception so many clean documents and no toxic one.
LEAST_TOXIC, LEAST_WEIGHT, LEAST_EVIDENCE, LEAST_CLEAN = 3, 1.2, 20.0, 5
#: A beginning must stand for more than one word: so much more often than its most frequent longer entry.
LEAST_SPREAD = 1.25
#: A longer entry must beat the shorter one it begins with by this much.
LEAST_GAIN = 0.7
SHORTEST, LONGEST = 3, 12
#: Words of an exception phrase.
LONGEST_PHRASE = 3

# Letters of other scripts that look like Latin ones, and digits and signs used for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "з": "3", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "ς": "s", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t"}
#: What a character may stand for in other readings.
READINGS = SUBSTITUTES | {"1": "il"}
INVISIBLE = "­​‌‍⁠﻿"

_LETTERS = str.maketrans(SUBSTITUTES)
#: Whole runs of letters, digits and signs that hold a digit or sign; every run is tried once, so long ones are cheap.
_DISGUISED = re.compile(r"(?<![a-z0-9@$!+])(?=[a-z]*+[0-9@$!+])[a-z0-9@$!+]++")
_SIGNS = re.compile(r"([@$!+]{2,})")
_WORD = re.compile(r"[^\W\d_]+")


class _Folded(dict):
    """Folding of single characters, made when first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = ""
        if c not in INVISIBLE:
            for x in unicodedata.normalize("NFKD", c.lower()):
                if not unicodedata.combining(x):
                    out += LOOK_ALIKES.get(x, x)
        self[code] = out
        return out


_FOLDED = _Folded()


def _undisguised(match: re.Match) -> str:
    """Single signs and digits before a letter stand for letters; runs of signs separate words and stay."""
    parts = _SIGNS.split(match[0])
    for k in range(0, len(parts), 2):
        word = parts[k]
        letters = [i for i, c in enumerate(word) if c.isalpha()]
        if letters and len(letters) * 5 >= len(word) * 2:
            end = letters[-1] + 1
            parts[k] = word[:end].translate(_LETTERS) + word[end:]
    return "".join(parts)


def _plain(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDED)


def fold(text: str) -> str:
    """``text`` without disguises, in lower-case letters without accents: of several readings, the first."""
    return _DISGUISED.sub(_undisguised, _plain(text))


def words(folded: str) -> list[str]:
    return _WORD.findall(folded)


@dataclass
class Model:
    """Entries and exceptions as patterns over words joined by blanks, and the logistic weights."""

    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    weights: tuple[float, ...] = (-2.0, 1.0, 0.0, 0.0, 0.0)

    def matcher(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for e, w in self.entries.items():
            found.add_word(f" {e}", (len(e) + 1, w, e))
        for e in self.exceptions:
            found.add_word(f" {e} ", (len(e) + 2, None, e))
        if len(found):
            found.make_automaton()
        return found


def _hits(matcher: ahocorasick.Automaton, ws: list[str]) -> dict[int, float]:
    """Positions of the words at which an entry begins outside exceptions, with the strongest weight."""
    line, spans, hits = f" {' '.join(ws)} ", [], {}
    if len(matcher) and ws:
        for end, (size, weight, _) in matcher.iter(line):
            if weight is None:
                spans.append((end - size + 1, end))
            elif weight > hits.get(end - size + 1, 0):
                hits[end - size + 1] = weight
    if spans and hits:
        hits = _outside(hits, spans)
    if not hits:
        return {}
    place = {at: k for k, at in enumerate(accumulate((len(w) + 1 for w in ws), initial=0))}
    return {place[at]: w for at, w in hits.items()}


def _outside(hits: dict[int, float], spans: list[tuple[int, int]]) -> dict[int, float]:
    """The hits at places that no half-open span covers."""
    starts, reach = [], []
    for a, b in sorted(spans):
        starts.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    covered = lambda at: (k := bisect_right(starts, at)) > 0 and at < reach[k - 1]
    return {at: w for at, w in hits.items() if not covered(at)}


def _phrases(matcher: ahocorasick.Automaton, ws: list[str], n: int) -> set[str]:
    """Runs of ``n`` words that hold a match."""
    return {" ".join(ws[a : a + n]) for k in _hits(matcher, ws) for a in range(max(0, k - n + 1), min(k, len(ws) - n) + 1)}


def _separable(run: str) -> list[bool]:
    """Which characters of a run may separate words: digits and signs at the ends of its parts, and rows of signs."""
    out, at = [True] * len(run), 0
    for k, part in enumerate(_SIGNS.split(run)):
        letters = [at + i for i, c in enumerate(part) if c.isalpha()] if k % 2 == 0 else []
        if letters:
            inner = range(letters[0], letters[-1] + 1)
            out[inner.start : inner.stop] = [run[i] not in READINGS and not run[i].isalpha() for i in inner]
        at += len(part)
    return out


def _readings(matcher: ahocorasick.Automaton, run: str, begins: bool, ends: bool) -> Iterator[tuple[int, int, str]]:
    """(start, end, word) of every reading of a part of ``run`` that is an entry or begins with one.

    A word starts and ends at separators, or at the ends of the run if it ``begins`` and ``ends`` there. Two
    fifths of its characters must be letters. The automaton's own trie directs the reading, so every
    start costs at most as many steps as there are entries' beginnings, however many readings there are.
    """
    last = max(i for i, c in enumerate(run) if c.isalpha())
    gap = _separable(run)

    def real(start: int, end: int) -> bool:
        return sum(c.isalpha() for c in run[start:end]) * 5 >= (end - start) * 2

    for start in range(last + 1):
        if not (gap[start - 1] if start else begins):
            continue
        todo = [(start, " ")]
        while todo:
            at, path = todo.pop()
            closed = gap[at] if at < len(run) else ends
            if closed and matcher.get(f"{path} ", (0, None))[1] is not None and real(start, at):
                yield start, at, path[1:]
            if matcher.get(path, (0, None))[1] is not None:
                end = at
                while end < len(run) and not gap[end]:
                    end += 1
                if real(start, end):
                    yield start, end, path[1:] + run[at:end].translate(_LETTERS)
            if at < len(run):
                todo += [(at + 1, path + c) for c in READINGS.get(run[at], run[at] if run[at].isalpha() else "") if matcher.match(path + c)]


def _other_hits(matcher: ahocorasick.Automaton, plain: str, folded: str, ws: list[str]) -> dict[int, tuple[float, str]]:
    """Hits that only other readings of disguised runs have: the position of the word, the weight and the reading."""
    begins: list[int] = []
    hits: dict[int, tuple[float, str]] = {}
    for m in _DISGUISED.finditer(plain):
        run = m[0]
        if not any(map(str.isalpha, run)):
            continue
        free = m.start() == 0 or not plain[m.start() - 1].isalpha(), m.end() == len(plain) or not plain[m.end()].isalpha()
        for start, end, word in set(_readings(matcher, run, *free)):
            if not begins:
                places = [x.span() for x in _WORD.finditer(folded)]
                begins, stops = [a for a, _ in places], [b for _, b in places]
            # folding keeps the length of runs, so places in the plain text are places in the folded one
            k, after = bisect_right(stops, m.start() + start), bisect_left(begins, m.start() + end)
            before = ws[max(0, k - LONGEST_PHRASE + 1) : k]
            weight = _hits(matcher, [*before, word, *ws[after : after + LONGEST_PHRASE - 1]]).get(len(before), 0)
            if weight > hits.get(k, (0, ""))[0]:
                hits[k] = weight, word
    return hits


def measures(matcher: ahocorasick.Automaton, text: str) -> tuple[float, ...]:
    """(1, log of weighted matches, weight per length, distinct words matched, log of length)."""
    plain = _plain(text)
    folded = _DISGUISED.sub(_undisguised, plain)
    ws = words(folded)
    hits = {k: (w, ws[k]) for k, w in _hits(matcher, ws).items()}
    if len(matcher) and ws:
        for k, other in _other_hits(matcher, plain, folded, ws).items():
            hits[k] = max(hits.get(k, other), other, key=lambda x: x[0])
    total = sum(w for w, _ in hits.values())
    distinct = len({word for _, word in hits.values()})
    return 1.0, float(np.log1p(total)), total / np.sqrt(len(ws) + 10), float(np.log1p(distinct)), float(np.log1p(len(ws)))


def probability(model: Model, x: tuple[float, ...]) -> float:
    z = max(-30.0, min(30.0, sum(a * b for a, b in zip(model.weights, x))))
    return float(1 / (1 + np.exp(-z)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, y`` of at most ``rows`` labelled documents outside the held-out fifth.

    Labelled rows are drawn by a hash of their id; the bounded draw is broadcast, so the documents are
    only scanned. Null texts count as empty; a label that is neither 0 nor 1 is left out; of rows with
    one id the labels are taken once.
    """
    picked = (
        labels.filter((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col(label).isin(0, 1))
        .select("doc_id", F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(rows)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")


def _begins(word: str) -> Iterator[str]:
    """The word itself, closed by a blank, and its beginnings."""
    yield f"{word} "
    yield from (word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))


def _document_counts(train: DataFrame, keys: Callable[[list[str]], set[str]]) -> DataFrame:
    """``k, clean, toxic``: how many documents of either label have each of the ``keys`` of their words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y].update(keys(words(fold(text))))
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield from flush(seen)
        yield from flush(seen)

    def flush(seen: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for y, counts in enumerate(seen):
            found = list(counts)
            got = pa.array([counts[k] for k in found], pa.int64())
            none = pa.array(np.zeros(len(found)), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *((none, got) if y else (got, none))], ["k", "clean", "toxic"])
            counts.clear()

    counted = train.select("text", "y").mapInArrow(count, "k string, clean long, toxic long")
    return counted.groupBy("k").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon, exceptions and logistic weights from labelled documents.

    Document counts of words and beginnings, then of pairs and triples around their matches, are summed in
    Spark; what reaches the driver is what the evidence selects from ``rows`` documents, and five numbers for each
    of them. Without labels of both kinds the model has no entries and scores every document low.
    """
    train = materialise(training_rows(docs, labels, label, rows), "toxicity-sample")
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model({})

    totals = _document_counts(train, lambda ws: {b for w in set(ws) for b in _begins(w)})
    totals = materialise(totals.filter((F.col("toxic") >= LEAST_TOXIC) | (F.col("clean") >= LEAST_CLEAN)), "toxicity-counts")
    toxic, clean, every = F.col("toxic"), F.col("clean"), F.col("toxic") + F.col("clean")
    share = n[1] / (n[0] + n[1])
    part = lambda k, p: F.when(k > 0, k * F.log(k / (every * p))).otherwise(F.lit(0.0))
    best = (
        totals.filter(toxic >= LEAST_TOXIC)
        .withColumn("w", F.log((toxic + 0.5) / (n[1] + 1.0)) - F.log((clean + 0.5) / (n[0] + 1.0)))
        .withColumn("evidence", 2 * (part(toxic, share) + part(clean, 1 - share)))
        .filter((F.col("w") >= LEAST_WEIGHT) & (F.col("evidence") >= LEAST_EVIDENCE))
        .collect()
    )
    seen_in = {r["k"]: r["toxic"] for r in best}
    longer: dict[str, int] = {}
    for k, m in seen_in.items():
        for i in range(SHORTEST, len(k)):
            longer[k[:i]] = max(longer.get(k[:i], 0), m)
    entries: dict[str, float] = {}
    for r in sorted(best, key=lambda r: (len(r["k"]), r["k"])):
        k = r["k"]
        if not k.endswith(" ") and r["toxic"] < LEAST_SPREAD * longer.get(k, 0):
            continue
        shorter = max((entries[k[:i]] for i in range(SHORTEST, len(k)) if k[:i] in entries), default=None)
        if shorter is None or r["w"] >= shorter + LEAST_GAIN:
            entries[k] = float(r["w"])
    model = Model(entries, _exceptions(totals, entries))
    for n_words in range(2, LONGEST_PHRASE + 1):
        model.exceptions += _exception_phrases(train, model, n_words)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in slices(batches):
            rows_ = [measures(matcher, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([list(r) for r in rows_], pa.list_(pa.float64()))], ["y", "x"])

    got = train.select("text", "y").mapInArrow(measure, "y int, x array<double>").collect()
    model.weights = calibrated(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float))
    return model


def _exceptions(totals: DataFrame, entries: dict[str, float]) -> list[str]:
    """Words that begin with an entry but are only seen in clean documents."""
    begins = [e for e in entries if not e.endswith(" ")]
    if not begins:
        return []
    clean = totals.filter(F.col("k").endswith(" ") & (F.col("toxic") == 0) & (F.col("clean") >= LEAST_CLEAN))
    hit = F.array_contains(F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda i: F.substring("k", 1, i).isin(begins)), True)
    picked = clean.filter(hit).select("k").collect()
    return sorted(r["k"].strip() for r in picked)


def _exception_phrases(train: DataFrame, model: Model, n_words: int) -> list[str]:
    """Runs of ``n_words`` words around matches outside the exceptions so far that are only seen in clean documents."""
    if not model.entries:
        return []
    made: list[ahocorasick.Automaton] = []  # one a task

    def keys(ws: list[str]) -> set[str]:
        if not made:
            made.append(model.matcher())
        return _phrases(made[0], ws, n_words)

    clean = _document_counts(train, keys).filter((F.col("toxic") == 0) & (F.col("clean") >= LEAST_CLEAN))
    return sorted(r["k"] for r in clean.select("k").collect())


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic weights in which no measure of matches counts against toxicity: such a one is left out."""
    kept = list(range(x.shape[1]))
    while True:
        w = dict(zip(kept, logistic(x[:, kept], y)))
        wrong = min((k for k in kept if 0 < k < 4), key=w.get, default=None)
        if wrong is None or w[wrong] >= 0:
            return tuple(w.get(k, 0.0) for k in range(x.shape[1]))
        kept.remove(wrong)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the first column is the constant."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w)) * (np.arange(len(w)) > 0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` (0 to 1) of every whole text.

    One row per row of ``docs``, repeated rows and null ids included; null and empty texts are scored
    as texts without words. Only the text enters the score. Further columns are ignored; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in slices(batches):
            p = [probability(model, measures(matcher, t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Model, below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores less than ``below``.

    Null and empty texts are scored as texts without words; repeated rows and null ids are judged one by
    one; an empty table gives an empty result.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in slices(batches):
            clean = [probability(model, measures(matcher, t or "")) < below for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
