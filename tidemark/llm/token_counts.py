"""Token counts by a compiled finite-state transducer, without building the tokens.

**Compilation.** A sequence of BPE tokens is the encoding of its text exactly when every two adjacent
tokens are the encoding of theirs. So the last token of each prefix follows from the last tokens of
the shorter prefixes: it is the token ``t`` that ends there and may follow the last token of the prefix
before ``t``. What the future can depend on is finite: for every suffix that is a proper beginning of
some token, its place in the token trie, the last token before it, and how many tokens lay before it
compared with now. That tuple is a state. A transition reads one symbol (a byte, or a byte that ends
its word) and is annotated with the change of the token count. The transducer is deterministic;
states are made when first reached, as in lazy automata.

**Composition.** White space puts the transducer into its start state. A chunk of text is therefore
a map from entry states to (count, exit state) that needs only three things: what it reads before the
first white space (the head, run from the entry state), the count of its middle, which no entry state
can change, and what it reads after the last white space (the tail). Head and tail are kept as text.
Such maps compose associatively; those of a text are composed one after another in the task that holds
it, and a text without white space is counted as one run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import WordBpe
from tidemark.llm.common import Memo, is_plain, slices

#: Characters of normalised text in one chunk.
CHUNK_CHARS = 1 << 16
#: When the machine has more states than this it is compiled afresh.
STATE_LIMIT = 200_000
MEMO_WORDS = 400_000


class Transducer:
    """The lazily compiled machine over the symbols of one tokenizer."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.end = {s: s + bpe.end for s in bpe.spell}
        self.trie: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        self.parts: dict[str, tuple[str, ...]] = {}
        for token in bpe.ids:
            symbols = bpe.token_symbols(token)
            if tuple(bpe.encode_fragment(symbols)) == (token,):  # others never come out of the merges
                self.parts[token] = symbols
                node = 0
                for s in symbols:
                    if s not in self.trie[node]:
                        self.trie[node][s] = len(self.trie)
                        self.trie.append({})
                        self.token.append(None)
                    node = self.trie[node][s]
                self.token[node] = token
        self.follows = Memo(self._follows, 1_000_000)
        self.reset()

    def reset(self) -> None:
        start = ((0, None, 0),)
        self.number, self.states = {start: 0}, [start]
        self.next: list[dict[str, tuple[int, int]]] = [{}]

    def _follows(self, pair: tuple[str, str]) -> bool:
        a, b = pair
        return self.bpe.encode_fragment(self.parts[a] + self.parts[b]) == [a, b]

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        """The transition of ``state`` on ``symbol``: (next state, change of the count)."""
        last, gain, alive = None, 0, []
        for node, before, tokens in self.states[state]:
            to = self.trie[node].get(symbol)
            if to is None:
                continue
            token = self.token[to]
            if last is None and token is not None and (before is None or self.follows[before, token]):
                last, gain = token, tokens + 1
            if self.trie[to]:
                alive.append((to, before, tokens))
        key = (*[(node, before, tokens - gain) for node, before, tokens in alive], (0, last, 0))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
        step = self.next[state][symbol] = (self.number[key], gain)
        return step

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        if len(self.states) > STATE_LIMIT:
            self.reset()
        spell, table, state, total = self.bpe.spell, self.next, 0, 0
        *body, last = word.encode()
        for b in body:
            symbol = spell[b]
            state, gain = table[state].get(symbol) or self._compile(state, symbol)
            total += gain
        symbol = self.end[spell[last]]
        return total + (table[state].get(symbol) or self._compile(state, symbol))[1]


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to any entry state. ``tail`` is None when the chunk holds no white space."""

    head: str
    middle: int
    tail: str | None

    def then(self, after: "ChunkMap", count) -> "ChunkMap":
        """This chunk followed by another; ``count`` gives the tokens of a run without white space."""
        if self.tail is None:
            return ChunkMap(self.head + after.head, after.middle, after.tail)
        joined = self.tail + after.head
        if after.tail is None:
            return ChunkMap(self.head, self.middle, joined)
        return ChunkMap(self.head, self.middle + count(joined) + after.middle, after.tail)


def scan(maps: list[ChunkMap], count) -> list[ChunkMap]:
    """Inclusive prefix scan: entry ``i`` is the composition of the first ``i + 1`` maps.

    Pairs are composed, their scan is taken, and every second entry is filled in: the steps of one
    level do not depend on each other.
    """
    if len(maps) < 2:
        return maps
    paired = scan([a.then(b, count) for a, b in zip(maps[::2], maps[1::2])], count)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(paired[i // 2] if i % 2 else paired[i // 2 - 1].then(maps[i], count))
    return out


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS):
        self.bpe, self.chunk_chars = WordBpe(path), chunk_chars
        self.machine = Transducer(self.bpe)
        self.memo = Memo(self._run, MEMO_WORDS)

    def _run(self, text: str) -> int:
        return sum(map(self.machine.count, self.bpe.pre_tokens(text)))

    def run(self, text: str) -> int:
        """Tokens of normalised text without white space."""
        return self.memo[text]

    def chunk_map(self, chunk: str, plain: bool) -> ChunkMap:
        runs = chunk.split(" ") if not plain else chunk.replace("\n", " ").split(" ")
        if len(runs) == 1:
            return ChunkMap(chunk, 0, None)
        tail = runs.pop()
        head, *middle = runs
        return ChunkMap(head, sum(map(self.memo.__getitem__, middle)), tail)

    def normalised(self, text: str, plain: bool) -> int:
        """Tokens of normalised text, chunk by chunk."""
        size = self.chunk_chars
        maps = [self.chunk_map(text[i : i + size], plain) for i in range(0, len(text), size)]
        if not maps:
            return 0
        whole = scan(maps, self.run)[-1]
        return self.run(whole.head) + whole.middle + self.run(whole.tail or "")

    def count(self, text: str) -> int:
        total = 0
        for part, special in self.bpe.pieces(text):
            total += 1 if special is not None else self.normalised(part, is_plain(part))
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of whole texts: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    One row per row of ``docs``, repeated rows and null ids included. Null and empty texts have no
    bytes and no tokens. ``over_limit`` is false at exactly ``limit`` tokens. Further columns are
    ignored, whatever their names; an empty table gives an empty result. Time is linear in the text,
    for words of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer_path)
        for batch in slices(batches):
            n = [own.count(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), text_col)
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
