"""Best-fit packing of token sequences by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens. Each partition of pieces is packed best-fit
decreasing on its own; bins that are (nearly) full are final. The underfull rest go on as items of the
next round, where the bins of several partitions meet in one group, until all fit in one group or a
round no longer lowers their number. A group never holds more than ``group_items`` items, so no task
grows with the corpus, and what moves between tasks are bins of a few numbers per piece, never texts.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import is_plain, slices
from tidemark.scratch import materialise

CAPACITY = 1024
#: Bins with at most this much room left are final: only items this short could still enter.
NEARLY_FULL = 2
#: Items that one task packs at once, and how many bins a later round's group gathers at most.
GROUP_ITEMS = 40_000
#: A round that removes less than this share of the bins was the last.
LEAST_GAIN = 0.002

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
BINS = f"used long, members array<struct<{PIECES.replace(' long', ': long').replace(' int', ': int')}>>"


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to the library's.

    Plain texts are encoded by the faster twin library from the same vocabulary as ranks; texts with
    other characters, where Unicode versions may differ, or with special strings go to the library.
    """

    def __init__(self, path: str, ranks_path: str | None):
        self.library = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()))
        self.twin = None
        if ranks_path:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.twin = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.twin is None or not is_plain(text) or self.special.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.twin.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def ids_of(path: str, ranks_path: str | None) -> Ids:
    return Ids(path, ranks_path)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first of several may be shorter than full."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *[(s, capacity) for s in range(first, length, capacity)]]


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    end_id: int = 2,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32``.

    A document is the ids of its whole text (special strings inside it handled as the library does by
    default) and ``end_id``; null and empty texts are the end id alone. Each row of ``docs`` is a
    document, repeated rows included; null ids stay null. Further columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ids_of(tokenizer_path, ranks_path)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = (own(text) if text else b"") + end
                if len(ids) <= 4 * capacity:
                    rows.append((doc, 0, 0, len(ids) // 4, zlib.crc32(ids)))
                else:
                    for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, PIECES)


def best_fit(used: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of the items of each bin.

    Items of one size go together, largest first; each goes into the fullest bin that still takes it.
    """
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the amounts of room that some bin has, ascending
    for i in np.argsort(-used, kind="stable").tolist():
        size = int(used[i])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            room, bin_ = capacity, []
        else:
            room = rooms[at]
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bin_.append(i)
        left = room - size
        if not by_room[left]:
            bisect.insort(rooms, left)
        by_room[left].append(bin_)
    return [b for bins in by_room for b in bins]


def _pack(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    used, members = frame["used"].to_numpy(), frame["members"].tolist()
    out_used, out_members = [], []
    for bin_ in best_fit(used, capacity):
        out_used.append(int(used[bin_].sum()))
        out_members.append([m for i in bin_ for m in members[i]])
    return pd.DataFrame({"used": out_used, "members": out_members})


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """Bins (``used``, ``members``) of the pieces: every piece is in exactly one, and none overflows.

    Pieces of ``capacity`` are bins of their own from the start. Items have at least one token, so a
    bin has at most ``capacity`` members. An empty frame gives no bins.
    """
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    done = [items.filter(F.col("length") >= capacity).select(F.col("length").alias("used"), F.array(member).alias("members"))]

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _gather(frames, group_items):
            yield _pack(frame, capacity)

    open_ = items.filter(F.col("length") < capacity).select(F.col("length").alias("used"), F.array(member).alias("members"))
    before = None
    while True:
        bins = materialise(open_.mapInPandas(local, BINS), "packing")
        full = F.col("used") >= capacity - nearly_full
        n = bins.filter(~full).count()
        last = n == 0 or before is not None and (before[0] == 1 or n > before[1] * (1 - LEAST_GAIN))
        if last:
            done.append(bins)
            break
        done.append(bins.filter(full))
        groups = -(-n // group_items)
        # Underfull bins meet in as few groups as their number allows; each round has fewer.
        open_ = bins.filter(~full).repartition(groups, F.xxhash64(F.col("members")[0], F.lit(len(done))))
        before = (groups, n)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _gather(frames: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """The rows of a partition in frames of at most about ``limit`` rows."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= limit:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def sequences(bins: DataFrame) -> DataFrame:
    """One row per piece with ``sequence_id`` and ``offset``, the gapless place in its sequence.

    The id is drawn once, and the frame written, so that a recomputed task cannot renumber it.
    """
    numbered = materialise(bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members"), "sequences")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for number, members in zip(frame["sequence_id"], frame["members"]):
                offset = 0
                for m in members:
                    rows.append((*(m[c] for c in PLACED[:5]), number, offset))
                    offset += m["length"]
            yield pd.DataFrame(rows, columns=PLACED)

    return numbered.mapInPandas(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    end_id: int = 2,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens; see :func:`pieces` and :func:`pack`."""
    made = materialise(pieces(docs, tokenizer_path, ranks_path, end_id, capacity, id_col, text_col), "pieces")
    return sequences(pack(made, capacity))
