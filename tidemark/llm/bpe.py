"""BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent symbols that occurs inside no vocabulary token can never be bridged by a merge, so
every such pair is a certain cut. A word is cut there, its fragments are encoded independently (and
memoised, since fragments recur far more often than words), and their ids are concatenated. Decoding goes from
ids to the vocabulary's strings.

A *symbol* is one byte of the text in byte-level spelling; the last byte of a word carries the end
mark, so "n" inside a word and "n" at its end are different symbols.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemark.llm.common import Memo, is_plain, slices

MEMO_WORDS = 600_000
MEMO_FRAGMENTS = 300_000
#: Longer fragments are encoded with a heap: the simple loop is quadratic.
HEAP_FROM = 48
NO_RANK = 1 << 62
#: Bits of an id where two are one number.
SHIFT = 24


def byte_spelling() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the other bytes take the characters from U+0100 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordBpe:
    """The tables of a word-end BPE tokenizer file: spelling, merges, certain cuts, pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.library = Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.pair_ranks = {self.ids[a] << SHIFT | self.ids[b]: r for (a, b), r in self.ranks.items()}
        self.merged = [self.ids[a + b] for a, b in model["merges"]]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.words = regex.compile(split)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.spell = byte_spelling()
        self.inside = {pair for t in map(self.token_symbols, self.ids) for pair in zip(t, t[1:])}
        # the same by bytes: ids of symbols, and pairs that are no cut, before the last byte and with it
        self.symbol_ids = [self.ids[c] for c in self.spell], [self.ids[c + self.end] for c in self.spell]
        pairs = [bytes([a, b]) for a in range(256) for b in range(256)]
        self.follows = {tuple(p) for p in pairs if (self.spell[p[0]], self.spell[p[1]]) in self.inside}
        self.closes = {p for p in pairs if (self.spell[p[0]], self.spell[p[1]] + self.end) in self.inside}

    def token_symbols(self, token: str) -> tuple[str, ...]:
        """The symbols a vocabulary token is made of."""
        if token.endswith(self.end) and len(token) > len(self.end):
            *body, last = token[: -len(self.end)]
            return (*body, last + self.end)
        return tuple(token)

    def symbols(self, word: str) -> list[str]:
        """The word's bytes in byte-level spelling, the last with the end mark."""
        out = [self.spell[b] for b in word.encode()]
        out[-1] += self.end
        return out

    def fragments(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """Maximal runs in which every adjacent pair occurs inside some token."""
        inside, out, start = self.inside, [], 0
        for i, pair in enumerate(zip(symbols, symbols[1:]), 1):
            if pair not in inside:
                out.append(tuple(symbols[start:i]))
                start = i
        out.append(tuple(symbols[start:]))
        return out

    def cut(self, word: bytes) -> list[bytes]:
        """:meth:`fragments` as bytes of the word; the last one carries the end mark."""
        follows, out, start, last = self.follows, [], 0, len(word) - 1
        if not follows.issuperset(zip(word, word[1:last])):
            for i, pair in enumerate(zip(word, word[1:last]), 1):
                if pair not in follows:
                    out.append(word[start:i])
                    start = i
        if last > 0 and word[last - 1 :] not in self.closes:
            out.append(word[start:last])
            start = last
        out.append(word[start:])
        return out

    def encode_inner(self, fragment: bytes) -> list[int]:
        """Ids of a fragment of :meth:`cut` that does not end its word."""
        symbol = self.symbol_ids[0]
        return self.merge([symbol[b] for b in fragment])

    def encode_closing(self, fragment: bytes) -> list[int]:
        """Ids of a fragment of :meth:`cut` that ends its word."""
        symbol, last = self.symbol_ids
        return self.merge([*[symbol[b] for b in fragment[:-1]], last[fragment[-1]]])

    def encode_fragment(self, fragment: tuple[str, ...]) -> list[str]:
        """Tokens of a fragment."""
        return [self.tokens[i] for i in self.merge([self.ids[s] for s in fragment])]

    def merge(self, parts: list[int]) -> list[int]:
        """The pair of lowest rank is merged, the leftmost first, until none is left. Pairs are one number each."""
        if len(parts) >= HEAP_FROM:
            return self._merge_long(parts)
        rank, merged = self.pair_ranks.get, self.merged
        ranks = [rank(a << SHIFT | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < NO_RANK:
            at = ranks.index(best)
            parts[at] = one = merged[best]
            del ranks[at], parts[at + 1]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << SHIFT | one, NO_RANK)
            if at < len(ranks):
                ranks[at] = rank(one << SHIFT | parts[at + 1], NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        ranks = self.pair_ranks
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        heap = [(ranks[p], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (p := a << SHIFT | b) in ranks]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.merged[best], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (pair := parts[left] << SHIFT | parts[right]) in ranks:
                    heapq.heappush(heap, (ranks[pair], left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(normalised text, None) and (special string, its id) in order, as the library splits them."""
        for part in self.special.split(text) if "<|" in text else [text]:
            if part in self.specials:
                yield part, self.specials[part]
            elif part:
                yield part.lower() if is_plain(part) else self.library.normalizer.normalize_str(part), None

    def pre_tokens(self, chunk: str) -> list[str]:
        """Words of normalised text. Blanks separate words, so chunks between blanks may be split alone.

        Plain chunks are split by pattern; others by the library's own first pre-tokenizer, whose
        letter classes may be of another Unicode version.
        """
        if is_plain(chunk):
            return self.words.findall(chunk)
        return [w for w, _ in self.library.pre_tokenizer[0].pre_tokenize_str(chunk)]


class Codec:
    """Encodes texts to ids and decodes ids to texts; chunks between blanks and fragments are memoised."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self.inner = Memo(self.bpe.encode_inner, MEMO_FRAGMENTS)
        self.closing = Memo(self.bpe.encode_closing, MEMO_FRAGMENTS)
        self.chunk = Memo(self._chunk, MEMO_WORDS)
        self.tokens = self.bpe.tokens | {i: t for t, i in self.bpe.specials.items()}

    def _chunk(self, chunk: str) -> tuple[tuple[int, ...], str]:
        """The ids of a chunk, and as decimals, each preceded by a blank."""
        b, ids = self.bpe, []
        for word in b.pre_tokens(chunk):
            *inner, last = b.cut(word.encode())
            for fragment in inner:
                ids += self.inner[fragment]
            ids += self.closing[last]
        return tuple(ids), "".join([f" {i}" for i in ids])

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids of a text, and as decimals joined by blanks."""
        ids: list[int] = []
        decimals: list[str] = []
        for part, special in self.bpe.pieces(text):
            if special is not None:
                ids.append(special)
                decimals.append(f" {special}")
                continue
            found = [*map(self.chunk.__getitem__, part.split() if is_plain(part) else part.split(" "))]
            ids += chain.from_iterable([own for own, _ in found])
            decimals += [text_of for _, text_of in found]
        return ids, "".join(decimals)[1:]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, specials included. The tokenizer file names no decoder, so the tokens' strings are joined
        by blanks; ids outside the vocabulary have none and are passed over."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode them again: one row per row of ``docs``.

    Columns: the id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by one blank) and
    ``decoded_sha256`` (decoded text in UTF-8), digests in lower-case hexadecimal.

    Null and empty texts have no tokens and the digest of the empty string. Null ids and repeated
    rows are kept as they are; further columns are ignored, whatever their names. An empty table
    gives an empty result. Long texts and words cost time in proportion to their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in slices(batches):
            n, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                found, decimals = own.encode(text or "")
                n.append(len(found))
                ids.append(hashlib.sha256(decimals.encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(found).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
