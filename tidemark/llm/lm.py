"""Language-model scores by online logistic mixing of hashed-context bit predictors, beside a unigram base.

**Text.** Lower-cased words joined by blanks, closed by a byte that UTF-8 never uses: the model gives the
probability of the sequence of tokens, as the base does. A byte is predicted as the bits of a prefix code
built from the corpus' counts of bytes after the last three bytes of the word so far where these are among the
most frequent, else after each byte, so common bytes cost few predictions.

**Predictors.** Each context has a table of slots. A bit falls into the slot of the hash of its context and its
place in the code; a slot counts zeros and ones over all training documents and predicts the log-odds.
Contexts inside the current word are counted on the corpus' distinct tokens, weighted by their counts: these are
far fewer than the running bytes. Contexts of the last bytes, whatever they are, are counted on the running
text: tasks count their own documents. Tables are cut into blocks that are shuffled and summed. Their size
grows with the corpus, within bounds that limit what is broadcast, at a byte a slot.

**Mixing.** The log-odds are summed with weights and squashed. The weights are gated: which of the longer
contexts have been seen chooses the weight vector. They are refined online: a segment of ``SEGMENT`` bytes
starts with the corpus' weights, and after each block of ``BLOCK`` bytes they follow the gradient of the
coding cost of that block. Blocks of many segments are computed together. A bit is predicted from
what stands before it only, so the probabilities of all token sequences sum to one. The corpus' weights
are fitted by Newton steps of the coding cost on a share of the training documents, by tables without them;
afterwards these are counted too.

**Base.** Token counts of all training documents. The ``FREQUENT`` most frequent tokens are broadcast; all
others of a document meet their counts in a shuffle join.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.scratch import materialise

END = 0xFF
BLANK = 0x20
FOLDS = 10
#: Documents of this fold of the id's checksum are held out; every so many-th of the others fits the weights first.
HELD_OUT, WEIGHT_SHARE = 0, 100
#: Contexts inside the current word (all of it so far), counted on distinct tokens, and contexts of the last bytes
#: (eight at most) whatever they are, counted on running text.
IN_WORD, RUNNING = ("word",), ("o4", "o6")
CONTEXTS = IN_WORD + RUNNING
#: The contexts whose being seen chooses the weights.
GATED = (0, 1, 2)
#: Codes are chosen by so many last bytes of the word, the blank before it included, hashed to so many bits; the most
#: frequent of these hashes have a code of their own.
CODE_BYTES, CODE_HASH_BITS, OWN_CODES = 3, 16, 512
#: Slots of a table: one for this power of two of bytes of the corpus, within bounds (powers of two as well).
LEAST_BITS, MOST_BITS, BYTES_A_SLOT = 16, 22, 1
#: Slots of a table in one shuffled row.
BLOCK_SLOTS = 4096
BLOCKS_A_TASK = 64
SEGMENT, BLOCK, LANES = 4096, 64, 192
RATE = 0.004
#: Newton steps to the corpus' weights, from this weight of every context, with this ridge towards it.
WEIGHT_ROUNDS, START, RIDGE = 3, 0.3, 10.0
#: Mixed log-odds stay within this.
CERTAIN = 12
#: Log-odds are stored in steps of 1 / this, in a byte.
STEPS = 12
PRIOR = 0.4
#: Texts are read in chunks of so many bytes; contexts reach back so far.
CHUNK, REACH = 1 << 20, 256
#: Contexts are hashed for about so many bytes at once.
TILE = 1 << 14
#: Bytes, and tokens, counted at once.
AT_ONCE, COUNT_AT_ONCE, COUNT_TOKENS = 1 << 19, 1 << 20, 1 << 15
FREQUENT, FREQUENT_BYTES = 1 << 17, 64
#: Tokens a task counts at once before it sends them on.
TOKENS_AT_ONCE = 3_000_000
#: Counting tasks are not made fewer than this.
LEAST_TASKS = 4


def checksum(id_col: str) -> Column:
    """Rows without an id have checksum 0 and are held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def held_out(id_col: str) -> Column:
    return checksum(id_col) % FOLDS == HELD_OUT


def fits_weights(id_col: str) -> Column:
    return checksum(id_col) % WEIGHT_SHARE == HELD_OUT + 1


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# Prefix code

def _paths(counts: list[int]) -> list[list[tuple[int, int]]]:
    """The path (inner node, bit) of every byte in the Huffman tree of 256 counts; nodes often met have low numbers."""
    heap: list[tuple[int, int, object]] = [(256 * c + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    made = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], made, (a[2], b[2])))
        made += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    todo, number = [(heap[0][2], [])], 0
    while todo:
        tree, path = todo.pop()
        if isinstance(tree, int):
            paths[tree] = path
        else:
            todo += [(tree[bit], [*path, (number, bit)]) for bit in (0, 1)]  # the heavier branch comes next
            number += 1
    return paths


def endings(data: np.ndarray) -> np.ndarray:
    """The hash of the word's last bytes up to every byte, -1 where that byte is all there is of a word."""
    last = np.where(data == END, np.uint32(BLANK), data.astype(np.uint32))
    within = (last != BLANK).astype(np.uint32)[1:]
    key = last
    for _ in range(CODE_BYTES - 1):
        longer = last.copy()
        longer[1:] |= (key[:-1] << np.uint32(8)) * within
        key = longer
    h = ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - CODE_HASH_BITS)).astype(np.int32)
    return np.where(key > END, h, np.int32(-1))


@dataclass(frozen=True)
class Code:
    """Prefix codes of bytes, flattened: paths of (inner node, bit), as ``2 * node + bit``.

    The first 256 codes are those by the byte before; ``own`` gives the code of every hash of a word's last bytes,
    -1 for none. Its last entry, that of hash -1, is none.
    """

    start: np.ndarray
    length: np.ndarray
    paths: np.ndarray
    own: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, own: dict[int, np.ndarray] | None = None) -> "Code":
        """Huffman codes of counts by byte before and byte, and of ``own`` counts by hash of the last bytes; all that never
        occurs before anything shares one code."""
        own = own or {}
        shared = _paths(counts.sum(axis=0).tolist())
        paths = [path for row in counts for path in (_paths(row.tolist()) if row.any() else shared)]
        paths += [path for row in own.values() for path in _paths(row.tolist())]
        length = np.array([len(p) for p in paths], np.int32)
        order = np.lexsort((length, np.arange(len(paths)) >> 8))  # a code's short paths lie together
        start = np.empty_like(length)
        start[order] = np.cumsum(length[order]) - length[order]
        chosen = np.full((1 << CODE_HASH_BITS) + 1, -1, np.int32)
        chosen[list(own)] = 256 + np.arange(len(own))
        return cls(start, length.astype(np.uint8), np.array([2 * n + bit for i in order for n, bit in paths[i]], np.uint16), chosen)

    def pairs(self, data: np.ndarray) -> np.ndarray:
        """The code of every byte, from the bytes before it, and the byte, as ``256 * code + byte``; the first one's code is any."""
        codes = np.zeros(len(data), np.int32)
        found = self.own.take(endings(data[:-1]), mode="wrap")
        codes[1:] = np.where(found < 0, data[:-1], found)
        return codes << np.int32(8) | data

    def spell(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every bit of ``pairs`` the place of its byte, its node, and itself."""
        length = self.length.take(pairs).astype(np.int64)
        owner = np.repeat(np.arange(len(pairs)), length)
        at = (self.start.take(pairs) + length - np.cumsum(length)).take(owner)
        at += np.arange(len(at))
        path = self.paths.take(at)
        return owner, (path >> np.uint16(1)).astype(np.int64), path & np.uint16(1)


# Contexts

def chunks(tokens: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """A document as (what stands before, bytes to predict) pairs: words, each closed by a blank, then the end."""
    data = b" ".join([*tokens, bytes([END])])
    for at in range(0, len(data), CHUNK):
        yield bytes([END]) * 8 if at == 0 else bytes([END]) + data[max(0, at - REACH + 1) : at], data[at : at + CHUNK]


def join(pairs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in one array, and where each pair's bytes to predict start and how many they are."""
    sizes = np.array([(len(a), len(b)) for a, b in pairs]).reshape(-1, 2)
    starts = np.cumsum(sizes.sum(axis=1)) - sizes[:, 1]
    return np.frombuffer(b"".join(x for pair in pairs for x in pair), np.uint8), starts, sizes[:, 1]


def tiles(pairs: list[tuple[bytes, bytes]]) -> Iterator[list[tuple[bytes, bytes]]]:
    """``pairs`` in runs of about ``TILE`` bytes: what is computed for one stays in the processor's cache."""
    first, held = 0, 0
    for at, (before, data) in enumerate(pairs, 1):
        held += len(before) + len(data)
        if held >= TILE or at == len(pairs):
            yield pairs[first:at]
            first, held = at, 0


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """32 well-mixed bits of 64-bit keys."""
    h = h * _ODD
    h += np.uint64(salt)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(32)
    return h.astype(np.uint32)


def hashes(data: np.ndarray, names: tuple[str, ...] = CONTEXTS) -> list[np.ndarray]:
    """The hash of each context at every byte, from the bytes before it."""
    wide, out = data.astype(np.uint64), []
    key, held = np.zeros(len(data), np.uint64), 0
    for name in names:
        if name == "word":
            h = _word_hash(data, wide)
        else:
            if held > int(name[1:]):
                key, held = np.zeros(len(data), np.uint64), 0
            for back in range(held + 1, int(name[1:]) + 1):
                key[back:] |= wide[:-back] << np.uint64(8 * back - 8)
            h, held = key, int(name[1:])
        out.append(_mix(h, CONTEXTS.index(name) + 1))
    return out


def _word_hash(data: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """A polynomial of the word so far, at every byte."""
    start = np.flatnonzero(np.concatenate([[True], ((data == BLANK) | (data == END))[:-1]]))
    size = np.diff(start, append=len(data))
    place = np.arange(len(data)) - np.repeat(start, size)
    terms = np.cumprod(np.full(int(size.max()), _ODD)).take(place)
    terms *= wide + np.uint64(1)
    total = np.zeros(len(data), np.uint64)
    np.cumsum(terms[:-1], out=total[1:])
    total -= np.repeat(total[start], size)
    return total


def slots(h: np.ndarray, owner: np.ndarray, nodes: np.ndarray, bits: int) -> np.ndarray:
    """The slot of every bit in the table of one context: nodes of one context lie near each other."""
    at = (h >> (32 - bits)).take(owner)
    at ^= nodes
    return at


def context_rows(pairs: list[tuple[bytes, bytes]], code: Code, names: tuple[str, ...]) -> np.ndarray:
    """A row for every byte of joined ``pairs``: the hash of each context, then its code and itself."""
    found, end = np.empty((sum(len(a) + len(b) for a, b in pairs), len(names) + 1), "<u4"), 0
    for tile in tiles(pairs):
        data = join(tile)[0]
        begin, end = end, end + len(data)
        for k, column in enumerate([*hashes(data, names), code.pairs(data)]):
            found[begin:end, k] = column
    return found


# Tables

def table_bits(n_bytes: int) -> dict[str, int]:
    """Slots of each context's table, as powers of two, for a corpus of so many bytes."""
    return dict.fromkeys(CONTEXTS, min(MOST_BITS, max(LEAST_BITS, max(n_bytes, 1).bit_length() - BYTES_A_SLOT)))


def gather(documents: Iterator[list[bytes]], size: int) -> Iterator[tuple[list[int], list[tuple[bytes, bytes]]]]:
    """Chunks of documents in groups of about ``size`` bytes, with the number of each one's document."""
    owners, group, held = [], [], 0
    for number, tokens in enumerate(documents):
        for pair in chunks(tokens):
            owners.append(number)
            group.append(pair)
            held += len(pair[1])
            if held >= size:
                yield owners, group
                owners, group, held = [], [], 0
    if group:
        yield owners, group


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in slices(batches):
        yield from map(words, batch.column(0).to_pylist())


def count_pairs(pairs: list[tuple[bytes, bytes]], code: Code, tables: dict[str, np.ndarray], times: np.ndarray | None = None) -> None:
    """Add the bits of ``pairs``, each counted ``times``, to flat tables of (zeros, ones) by slot.

    Equal bytes after equal contexts are added up first, in the order of the hashes, which is that of the slots.
    """
    _, starts, sizes = join(pairs)
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    found = context_rows(pairs, code, tuple(tables)).take(inside, axis=0)
    for k, table in enumerate(tables.values()):
        keys = found[:, k].astype(np.uint64) << np.uint64(32) | found[:, -1]
        if times is None:
            keys.sort()
        else:
            order = np.argsort(keys)
            keys, weights = keys[order], np.repeat(times, sizes)[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(first, append=len(keys)) if times is None else np.add.reduceat(weights, first)
        keys = keys[first]
        owner, nodes, values = code.spell(keys.astype(np.uint32).view(np.int32))
        at = slots((keys >> np.uint64(32)).view(np.int64), owner, nodes, (len(table) // 2).bit_length() - 1)
        np.add.at(table, 2 * at + values, n.astype(table.dtype).take(owner))


def _blocks(tables: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (context, block, counts) of all blocks that hold a count."""
    for name, table in tables.items():
        blocks = table.reshape(-1, 2 * BLOCK_SLOTS)
        for at in range(0, len(blocks), 256):
            rows = [(at + i, _pack(b)) for i, b in enumerate(blocks[at : at + 256]) if b.any()]
            columns = [pa.array([CONTEXTS.index(name)] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()),
                       pa.array([r[1] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["context", "block", "counts"])


COUNTS_SQL = "context int, block int, counts binary"


def running_counts(docs: DataFrame, text_col: str, code: Code, bits: dict[str, int]) -> DataFrame:
    """Zeros and ones of the running contexts over ``docs``, a set of blocks from every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {name: np.zeros(2 << bits[name], np.int32) for name in RUNNING}
        for _, group in gather(_documents(batches), COUNT_AT_ONCE):
            count_pairs(group, code, tables)
        yield from _blocks(tables)

    return docs.select(text_col).mapInArrow(run, COUNTS_SQL)


def word_counts(tokens: DataFrame, name: str, code: Code, bits: dict[str, int]) -> DataFrame:
    """Zeros and ones of a context inside the word, over distinct tokens (token, n); the end is the null token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {name: np.zeros(2 << bits[name], np.int64)}
        for batch in batches:
            for at in range(0, batch.num_rows, COUNT_TOKENS):
                some = batch.slice(at, COUNT_TOKENS)
                pairs, n = [], []
                for token, times in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    data = bytes([END]) if token is None else token + bytes([BLANK])
                    for start in range(0, len(data), CHUNK):
                        pairs.append((bytes([END]) + data[max(0, start - REACH) : start], data[start : start + CHUNK]))
                        n.append(times)
                count_pairs(pairs, code, tables, np.array(n))
        yield from _blocks(tables)

    return tokens.select("token", "n").mapInArrow(run, COUNTS_SQL)


def _pack(counts: np.ndarray) -> bytes:
    """Two, four or eight bytes a count; the reader tells by the size."""
    most = counts.max()
    return counts.astype("<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {2: "<u2", 4: "<u4", 8: "<u8"}[len(data) // (2 * BLOCK_SLOTS)]).astype(np.int64)


def sum_counts(partial: DataFrame, bits: dict[str, int], finish: Callable[[np.ndarray], bytes] = _pack) -> DataFrame:
    """Blocks of partial counts added up, and what ``finish`` makes of them.

    Rows of a block stream through one task, which holds sums only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for context, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                counts = _unpack(data.as_py())
                sums[context, block] = sums[context, block] + counts if (context, block) in sums else counts
        for (context, block), counts in sums.items():
            columns = [pa.array([context], pa.int32()), pa.array([block], pa.int32()), pa.array([finish(counts)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["context", "block", "counts"])

    blocks = sum(1 << b for b in bits.values()) // BLOCK_SLOTS
    return partial.repartition(max(1, blocks // BLOCKS_A_TASK), "context", "block").mapInArrow(run, COUNTS_SQL)


def odds_of(counts: np.ndarray) -> np.ndarray:
    """Log-odds of (zeros, ones) pairs in steps, a byte each."""
    pairs = counts.reshape(-1, 2)
    return np.clip(np.rint(STEPS * np.log((pairs[:, 1] + PRIOR) / (pairs[:, 0] + PRIOR))), -127, 127).astype(np.int8)


def log_odds(partial: DataFrame, bits: dict[str, int]) -> dict[str, np.ndarray]:
    """The tables of summed counts on the driver, a byte a slot: at most 2 ** MOST_BITS bytes a context."""
    tables = {name: np.zeros(1 << bits[name], np.int8) for name in CONTEXTS}
    for row in sum_counts(partial, bits, lambda counts: odds_of(counts).tobytes()).collect():
        at = row["block"] * BLOCK_SLOTS
        tables[CONTEXTS[row["context"]]][at : at + BLOCK_SLOTS] = np.frombuffer(row["counts"], np.int8)
    return tables


# Mixing

GATES = 1 << len(GATED)


def starting() -> np.ndarray:
    return np.array([START] * len(CONTEXTS) + [0.0])


@dataclass(frozen=True)
class Model:
    """Code, tables by context and starting weights (gates, contexts + 1; the last is a bias)."""

    code: Code
    tables: dict[str, np.ndarray]
    weights: np.ndarray
    rate: float = RATE

    @cached_property
    def flat(self) -> np.ndarray:
        """The tables one after another: in one large array, which the system may keep in large pages."""
        return np.concatenate([*self.tables.values()])

    def score(self, pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
        """Natural log-probability of each pair's bytes."""
        logs, m, rate = np.zeros(len(pairs)), len(self.tables), np.float32(self.rate)
        for of_lane, steps in self._lanes(pairs):
            weights = np.tile(self.weights.T, len(of_lane)).astype(np.float32)  # a column per lane and gate
            weights[:m] /= STEPS
            cost = np.zeros(weights.shape[1])
            for column, odds, sign in steps:
                dot = weights[m].take(column)
                for k in range(m):
                    one = weights[k].take(column)
                    one *= odds[k]
                    dot += one
                np.clip(dot, -CERTAIN, CERTAIN, out=dot)
                dot *= sign
                given = 1 / (1 + np.exp(-dot))  # the probability given to the bit
                cost += np.bincount(column, np.log(given), len(cost))
                push = (1 - given) * sign
                push *= rate
                np.add.at(weights[m], column, push)
                push /= STEPS * STEPS
                for k in range(m):
                    np.add.at(weights[k], column, push * odds[k])
            np.add.at(logs, of_lane, cost.reshape(-1, GATES).sum(axis=1))
        return logs

    def curvature(self, pairs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the coding cost in the starting weights, by gate."""
        m = len(self.tables) + 1
        slope, bend = np.zeros((GATES, m)), np.zeros((GATES, m, m))
        weights = self.weights.astype(np.float32)
        for _, steps in self._lanes(pairs):
            for column, odds, sign in steps:
                gate = column % GATES
                inputs = np.stack([*odds / np.float32(STEPS), np.ones_like(sign)], axis=1)
                dot = np.clip((weights[gate] * inputs).sum(axis=1), -CERTAIN, CERTAIN)
                wrong = 1 / (1 + np.exp(dot * sign))
                for g in np.unique(gate):
                    own = gate == g
                    x, w = inputs[own], wrong[own]
                    slope[g] += (w * sign[own]) @ x
                    bend[g] += x.T @ (x * (w * (1 - w))[:, None])
        return slope, bend

    def newton(self, slope: np.ndarray, bend: np.ndarray) -> "Model":
        """A ridged Newton step; gates that have seen little hardly move."""
        step = [np.linalg.solve(b + RIDGE * np.eye(len(s)), s - RIDGE * (w - starting())) for s, b, w in zip(slope, bend, self.weights)]
        return replace(self, weights=self.weights + np.array(step))

    def _lanes(self, pairs):
        """Groups of segments: the pair of each, and steps of one block of every segment.

        A step gives for every bit its column (segment and gate), stored log-odds by context, and 1 or -1 for one or zero.
        Neighbours are of different segments, so sums by column seldom wait for the one before.
        """
        _, starts, sizes = join(pairs)
        found = context_rows(pairs, self.code, tuple(self.tables))
        count = -(-sizes // SEGMENT)
        of_pair = np.repeat(np.arange(len(sizes)), count)
        first = starts[of_pair] + SEGMENT * (np.arange(len(of_pair)) - np.repeat(np.cumsum(count) - count, count))
        size = np.minimum((starts + sizes)[of_pair] - first, SEGMENT)
        order = np.argsort(-size, kind="stable")  # segments of like sizes go together
        for at in range(0, len(first), LANES):
            some = order[at : at + LANES]
            yield of_pair[some], self._steps(found, first[some], size[some])

    def _steps(self, found, first, size):
        place, lanes, m = np.arange(BLOCK)[:, None], np.arange(len(first)), len(self.tables)
        for begin in range(0, int(size[0]), BLOCK):
            full, alive = np.searchsorted(-size, [-begin - BLOCK + 1, -begin])  # sizes fall
            inside, lane = (first[:full] + begin + place).ravel(), np.tile(lanes[:full], BLOCK)
            if full < alive:
                here = place < size[full:alive] - begin
                inside = np.concatenate([inside, (first[full:alive] + begin + place)[here]])
                lane = np.concatenate([lane, np.broadcast_to(lanes[full:alive], here.shape)[here]])
            rows = found.take(inside, axis=0)
            owner, nodes, values = self.code.spell(rows[:, m].view(np.int32))
            begins, odds = 0, np.empty((m, len(nodes)), np.int8)
            for k, t in enumerate(self.tables.values()):
                at = slots(rows[:, k].astype(np.int64), owner, nodes, len(t).bit_length() - 1)
                at += begins
                self.flat.take(at, out=odds[k], mode="clip")
                begins += len(t)
            column, seen = (lane * GATES).take(owner), (odds != 0).view(np.int8)
            column += sum(seen[k] << np.int8(bit) for bit, k in enumerate(GATED))
            yield column, odds.astype(np.float32), values.astype(np.float32) * 2 - 1


def fit_weights(model: Model, docs: DataFrame, text_col: str, rounds: int = WEIGHT_ROUNDS) -> Model:
    """Newton steps over ``docs``; a task sends one gradient and curvature."""
    size = len(CONTEXTS) + 1
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slope, bend = np.zeros((GATES, size)), np.zeros((GATES, size, size))
            for _, group in gather(_documents(batches), AT_ONCE):
                s, b = shared.value.curvature(group)
                slope, bend = slope + s, bend + b
            values = np.concatenate([slope.ravel(), bend.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "value"])

        sums = docs.select(text_col).mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
        values = np.zeros(GATES * size * (1 + size))
        for row in sums.collect():
            values[row["at"]] = row["value"]
        model = model.newton(values[: GATES * size].reshape(GATES, size), values[GATES * size :].reshape(GATES, size, size))
    return model


# Base

def split(texts: pa.Array) -> pa.ListArray:
    """The words of many texts; an empty one may stand first and last."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Tokens of the training documents: ``token`` (null: the end), ``n``, and ``n_fit`` of them where weights are fitted."""

    def counted(held: list[pa.Array], ends: int, fits: bool) -> pa.RecordBatch:
        some = pc.value_counts(pa.chunked_array(held, pa.binary()))
        keys, n = some.field(0), some.field(1)
        real = pc.greater(pc.binary_length(keys), 0)
        keys = pa.concat_arrays([keys.filter(real), pa.array([None], pa.binary())])
        n = pa.concat_arrays([n.filter(real), pa.array([ends], pa.int64())])
        return pa.RecordBatch.from_arrays([keys, n, n if fits else pa.array(np.zeros(len(n), np.int64))], ["token", "n", "n_fit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[pa.Array]] = {False: [], True: []}
        ends, size = {False: 0, True: 0}, 0

        def rows() -> Iterator[pa.RecordBatch]:
            for fits in held:
                if ends[fits]:
                    yield counted(held[fits], ends[fits], fits)
                held[fits], ends[fits] = [], 0

        for batch in slices(batches):
            for fits in held:
                texts = batch.column(1).filter(pc.equal(batch.column(0), fits))
                held[fits].append(split(texts).flatten().cast(pa.binary()))
                ends[fits] += len(texts)
                size += len(held[fits][-1])
            if size > TOKENS_AT_ONCE:
                yield from rows()
                size = 0
        yield from rows()

    learned = docs.filter(~held_out(id_col)).select(fits_weights(id_col), text_col)
    partial = learned.mapInArrow(run, "token binary, n long, n_fit long")
    return partial.groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_fit").alias("n_fit"))


def byte_counts(tokens: DataFrame) -> np.ndarray:
    """How often each byte follows each byte in the training text; a document begins as after a blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, COUNT_TOKENS):
                some = batch.slice(at, COUNT_TOKENS)
                spelled = [bytes([BLANK, END]) if t is None else b" " + t + b" " for t in some.column(0).to_pylist()]
                lengths = np.array([len(t) for t in spelled])
                data = np.frombuffer(b"".join(spelled), np.uint8)
                times = np.repeat(some.column(1).to_numpy(zero_copy_only=False), lengths)
                times[np.cumsum(lengths) - lengths] = 0  # the blank before is not counted
                np.add.at(total, data[:-1].astype(np.int64) << 8 | data[1:], times[1:])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])

    rows = tokens.select("token", "n").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((256, 256), np.int64)
    for r in rows:
        counts[divmod(r["pair"], 256)] = r["n"]
    counts[END] = counts[BLANK]
    return counts


def own_counts(tokens: DataFrame) -> dict[int, np.ndarray]:
    """Counts of bytes after the ``OWN_CODES`` most frequent hashes of a word's last bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COUNT_TOKENS):
                some = batch.slice(at, COUNT_TOKENS)
                spelled = [b" " + t + b" " for t in some.column(0).to_pylist()]
                data = np.frombuffer(b"".join(spelled), np.uint8)
                times = np.repeat(some.column(1).to_numpy(zero_copy_only=False), [len(t) for t in spelled])[1:]
                ending = endings(data[:-1])
                told = np.flatnonzero(ending >= 0)
                keys, where = np.unique(ending[told].astype(np.int64) << 8 | data[1:][told], return_inverse=True)
                n = np.zeros(len(keys), np.int64)
                np.add.at(n, where, times[told])
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 8), pa.array(keys & 255), pa.array(n)], ["ending", "byte", "n"])

    found = tokens.filter("token is not null").select("token", "n").mapInArrow(run, "ending long, byte long, n long")
    found = materialise(found.groupBy("ending", "byte").agg(F.sum("n").alias("n")), "lm-endings")
    most = found.groupBy("ending").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "ending").limit(OWN_CODES)
    counts: dict[int, np.ndarray] = {}
    for r in found.join(F.broadcast(most), "ending").select("ending", "byte", "n").orderBy("ending", "byte").collect():
        counts.setdefault(r["ending"], np.zeros(256, np.int64))[r["byte"]] = r["n"]
    return counts


def fit(docs: DataFrame, tokens: DataFrame, id_col: str, text_col: str) -> Model:
    """Learn code, tables and weights from the training documents and their token counts."""
    counts = byte_counts(tokens)
    total = int(counts.sum() - counts[END].sum())
    bits, code = table_bits(total), Code.of(counts, own_counts(tokens))

    def tasks(names: tuple[str, ...], n_bytes: int) -> int:
        """So few that the tables they send are no larger than what they read."""
        return max(LEAST_TASKS, n_bytes // (4 * sum(1 << bits[n] for n in names)))

    def counted(docs: DataFrame, n: Column, label: str) -> DataFrame:
        some = tokens.select("token", n.alias("n")).filter("n > 0")
        partial = running_counts(docs.coalesce(tasks(RUNNING, total)), text_col, code, bits)
        for name in IN_WORD:
            partial = partial.union(word_counts(some.coalesce(LEAST_TASKS), name, code, bits))
        return materialise(sum_counts(partial, bits), label)

    learned = docs.filter(~held_out(id_col))
    rest = counted(learned.filter(~fits_weights(id_col)), F.col("n") - F.col("n_fit"), "lm-counts")
    model = Model(code, log_odds(rest, bits), np.tile(starting(), (GATES, 1)))
    fitting = materialise(learned.filter(fits_weights(id_col)).select(text_col), "lm-fitting")
    model = fit_weights(model, fitting, text_col)
    added = counted(fitting, F.col("n_fit"), "lm-added")
    return replace(model, tables=log_odds(rest.union(added), bits))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of whole texts: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``,
    ``bits_per_byte``.

    Logarithms are decimal. One row per row of ``docs``, repeated rows included; all of them are counted.
    Null and empty texts have one token, the end. Rows without an id are held out. Without training
    documents nothing is known and every bit has probability 1/2. Further columns are ignored, whatever their names; an
    empty table gives an empty result. Time is linear in the text.
    """
    spark = docs.sparkSession
    tokens = materialise(token_counts(docs, id_col, text_col), "lm-tokens")
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = spark.sparkContext.broadcast(fit(docs, tokens, id_col, text_col))
    known = tokens.filter(F.octet_length("token") <= FREQUENT_BYTES).orderBy(F.desc("n"), "token").limit(FREQUENT)
    frequent = spark.sparkContext.broadcast({bytes(r["token"]): r["n"] for r in known.select("token", "n").collect()})
    ends = tokens.filter(F.col("token").isNull()).select("n").collect()
    ended, whole = (ends[0]["n"] if ends else 0), n + 0.1 * (v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(frequent.value)}
        base_of = np.log10((np.array([*frequent.value.values(), 0]) + 0.1) / whole)
        base_of[-1] = 0.0  # of tokens that are not broadcast
        end_score = math.log10((ended + 0.1) / whole)
        for batch in slices(batches):
            documents = [words(t) for t in batch.column(2).to_pylist()]
            logs = np.zeros(len(documents))
            for owners, group in gather(iter(documents), AT_ONCE):
                np.add.at(logs, owners, model.value.score(group))
            lengths = [len(d) for d in documents]
            owner = np.repeat(np.arange(len(documents)), lengths)
            found = np.fromiter(map(place.get, chain.from_iterable(documents), repeat(-1)), np.int64, len(owner))
            base = end_score + np.bincount(owner, base_of[found], len(documents))
            seen = int(ended > 0) + np.bincount(owner, found >= 0, len(documents)).astype(np.int64)
            before = np.cumsum(lengths) - lengths
            others = [Counter() for _ in documents]
            for at, d in zip(np.flatnonzero(found < 0).tolist(), owner[found < 0].tolist()):
                others[d][documents[d][at - before[d]]] += 1
            rare = [o.items() for o in others]
            offsets = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
            flat = pa.StructArray.from_arrays(
                [pa.array([t for r in rare for t, _ in r], pa.binary()), pa.array([k for r in rare for _, k in r], pa.int64())], ["token", "k"])
            n_bytes = pa.array([sum(map(len, d)) + len(d) + 1 for d in documents], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(d) + 1 for d in documents], pa.int64()), n_bytes, pa.array(seen, pa.int64()),
                 pa.array(base, pa.float64()), pa.array(logs / np.log(10)), pa.ListArray.from_arrays(offsets, flat)],
                ["id", "held_out", "n_tokens", "n_bytes", "seen", "base", "score", "rare"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, held_out(id_col), text_col).mapInArrow(
        run, f"id {kind}, held_out boolean, n_tokens long, n_bytes long, seen long, base double, score double, "
        "rare array<struct<token: binary, k: bigint>>")
    scored = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "lm-scored")  # fixes the row numbers
    count = F.coalesce(F.col("n"), F.lit(0))
    others = scored.select("row", F.inline("rare")).join(tokens.select("token", "n"), "token", "left").groupBy("row").agg(
        F.sum(F.when(count > 0, F.col("k")).otherwise(0)).alias("more_seen"),
        F.sum(F.col("k") * F.log10((count + 0.1) / F.lit(whole))).alias("more_base"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("rare").join(others, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("seen") + zero("more_seen")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + zero("more_base")).alias("base_score"), "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"))
