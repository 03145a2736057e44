"""Fill-in-the-middle over seekable compressed frames.

**Store.** A text becomes independent zstandard frames of at most ``FRAME_BYTES`` bytes, cut between
code points, with cumulative counts of units, characters and bytes. A unit is the white space before a
word together with the word; white space at the end of the text is a unit of its own. In bytes a unit
ends where a word's last byte is followed by white space, and at the end of the text, so a frame may be
cut anywhere, words of any length included: its count says how many units *end* in it.

**Selection.** The frame of a cut is found by bisection in the cumulative unit counts; only the (at most
two) frames that hold cuts are decompressed. Output is made of frames again: those between cuts are
moved as they are, the edges of cut frames are compressed anew.

**Digests.** Frames are decompressed one at a time, in order. The restored text is read from the output
and its form alone: the markers are looked for, and the parts between them are streamed in text order.

Every function maps rows to rows without a shuffle; a task holds one row's compressed frames and one
decompressed frame.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.common import slices

FRAME_BYTES = 1 << 16
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Markers of each form in the order of the output.
ORDER = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}
#: Percent of texts that are rearranged, and of these the percent with the suffix first.
REARRANGED, SUFFIX_FIRST = 50, 80
SEED = "42"

FRAME = pa.struct([("data", pa.binary()), ("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64())])
FRAME_SQL = "array<struct<data: binary, units: bigint, chars: bigint, bytes: bigint>>"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_compress = zstandard.ZstdCompressor(level=LEVEL)
_decompress = zstandard.ZstdDecompressor()


def characters(data: bytes) -> int:
    """Code points of UTF-8 bytes: those that do not continue another."""
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def unit_ends(data: bytes) -> np.ndarray:
    """Offsets inside ``data`` at which a word is followed by white space."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    return np.flatnonzero(~space[:-1] & space[1:]) + 1


@dataclass
class Frames:
    """Compressed frames and what is counted up to the end of each."""

    data: list[bytes]
    units: list[int]
    chars: list[int]
    bytes: list[int]

    @classmethod
    def empty(cls) -> "Frames":
        return cls([], [], [], [])

    @classmethod
    def of(cls, text: bytes, size: int = FRAME_BYTES) -> "Frames":
        """Store a text."""
        out, at = cls.empty(), 0
        while at < len(text):
            to = min(at + size, len(text))
            while to < len(text) and text[to] & 0xC0 == 0x80:
                to -= 1
            part = text[at:to]
            ended = to == len(text) or (not _SPACE[text[to - 1]] and _SPACE[text[to]])
            out.add(part, len(unit_ends(part)) + int(ended))
            at = to
        return out

    def add(self, part: bytes, units: int = 0) -> None:
        """Compress and append; empty parts are left out."""
        if part:
            self.append(_compress.compress(part), units, characters(part), len(part))

    def append(self, frame: bytes, units: int, chars: int, size: int) -> None:
        last = (self.units[-1], self.chars[-1], self.bytes[-1]) if self.data else (0, 0, 0)
        self.data.append(frame)
        self.units.append(last[0] + units)
        self.chars.append(last[1] + chars)
        self.bytes.append(last[2] + size)

    def start(self, counts: list[int], i: int) -> int:
        return counts[i - 1] if i else 0

    def read(self, i: int) -> bytes:
        return _decompress.decompress(self.data[i])

    def seek(self, unit: int) -> tuple[int, int, int]:
        """Where ``unit`` units have ended: bytes before, characters before, and the frame looked at (-1: none)."""
        if unit == 0:
            return 0, 0, -1
        i = bisect_left(self.units, unit)
        part = self.read(i)
        ends, nth = unit_ends(part), unit - self.start(self.units, i) - 1
        offset = int(ends[nth]) if nth < len(ends) else len(part)
        return self.start(self.bytes, i) + offset, self.start(self.chars, i) + characters(part[:offset]), i

    def span(self, start: int, stop: int) -> Iterator[bytes]:
        """The bytes from ``start`` to ``stop``, a frame at a time."""
        i = bisect_right(self.bytes, start)
        while start < stop:
            first = self.start(self.bytes, i)
            yield self.read(i)[start - first : stop - first]
            start, i = self.bytes[i], i + 1

    def copy_span(self, source: "Frames", start: int, stop: int) -> None:
        """Append a span of ``source``: whole frames as they are, edges of cut frames compressed anew."""
        i = bisect_right(source.bytes, start)
        while start < stop:
            first, last = source.start(source.bytes, i), source.bytes[i]
            if start == first and stop >= last:
                counted = [c[i] - source.start(c, i) for c in (source.units, source.chars)]
                self.append(source.data[i], *counted, last - first)
            else:
                self.add(source.read(i)[start - first : stop - first])
            start, i = last, i + 1

    @property
    def size(self) -> int:
        return self.bytes[-1] if self.data else 0

    def markers(self, wanted: tuple[bytes, ...]) -> list[int]:
        """Where the markers first stand, one after another, those that straddle frames included."""
        found: list[int] = []
        rest, at = b"", 0
        for i in range(len(self.data)):
            window, base = rest + self.read(i), at - len(rest)
            seen = 0
            while len(found) < len(wanted) and (hit := window.find(wanted[len(found)], seen)) >= 0:
                found.append(base + hit)
                seen = hit + len(wanted[len(found) - 1])
            at = self.bytes[i]
            rest = window[max(seen, len(window) - 2) :]
        return found


def draws(key) -> list[int]:
    """Four unsigned integers of a row: the first 8-digit groups of the digest of seed and id."""
    digest = hashlib.sha256(f"{SEED}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def choose(key, n: int, marked: bool) -> tuple[str, int, int]:
    """Form of a text of ``n`` units, and the units before the middle and before the suffix."""
    h1, h2, h3, h4 = draws(key)
    if n == 0 or marked or h3 % 100 >= REARRANGED:
        return PLAIN, 0, 0
    return (SPM if h4 % 100 < SUFFIX_FIRST else PSM), *sorted((h1 % (n + 1), h2 % (n + 1)))


def rearrange(stored: Frames, form: str, first: int, second: int) -> tuple[Frames, int | None, int | None]:
    """Output frames, and the characters of prefix and middle."""
    if form == PLAIN:
        return stored, None, None
    (a, a_chars, _), (b, b_chars, _) = stored.seek(first), stored.seek(second)
    spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, stored.size)}
    out = Frames.empty()
    for marker in ORDER[form]:
        out.add(marker)
        out.copy_span(stored, *spans[marker])
    return out, a_chars, b_chars - a_chars


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text that ``output`` was made of, a frame at a time."""
    if form == PLAIN:
        yield from output.span(0, output.size)
        return
    at = output.markers(ORDER[form])
    spans = {m: (p + len(m), stop) for m, p, stop in zip(ORDER[form], at, [*at[1:], output.size])}
    for marker in (PREFIX, MIDDLE, SUFFIX):
        yield from output.span(*spans[marker])


def _digest(parts: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def _read(column: pa.Array) -> Iterator[Frames]:
    for row in column.to_pylist():
        yield Frames(*([f[k] for f in row or []] for k in ("data", "units", "chars", "bytes")))


def _write(rows: list[Frames]) -> pa.Array:
    offsets = np.cumsum([0, *(len(r.data) for r in rows)])
    flat = [pa.array([x for r in rows for x in getattr(r, f.name)], f.type) for f in FRAME]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(FRAME)))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The seekable store: the id, ``n`` units, whether the text is ``marked`` (holds a marker), ``frames``.

    One row per row of ``docs``, null ids and repeated rows included. Null and empty texts have no frames.
    Further columns are ignored, whatever their names; an empty table gives an empty store. Write it as
    Parquet to select from it many times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            rows = [Frames.of(t, frame_bytes) for t in texts]
            n = pa.array([r.units[-1] if r.data else 0 for r in rows], pa.int64())
            marked = pa.array([any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, marked, _write(rows)], ["id", "n", "marked", "frames"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, marked boolean, frames {FRAME_SQL}")
    return out.withColumnRenamed("id", id_col)


def transform(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rearranged texts: the id, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (null: plain), ``output`` frames.

    The rows of ``stored``, in any number. A null id draws as the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            forms, made = [], []
            keys, n, marked = (batch.column(i).to_pylist() for i in range(3))
            for key, units, mark, frames in zip(keys, n, marked, _read(batch.column(3))):
                form, first, second = choose(key, units, mark)
                forms.append(form)
                made.append(rearrange(frames, form, first, second))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(forms, pa.string()), pa.array([m[1] for m in made], pa.int64()),
                 pa.array([m[2] for m in made], pa.int64()), _write([m[0] for m in made])],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = stored.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output {FRAME_SQL}"
    return stored.select(id_col, "n", "marked", "frames").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``made`` with ``output_sha256`` and ``restored_sha256`` in place of the frames."""
    names = [id_col, "n", "form", "prefix_chars", "middle_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, back = [], []
            for form, frames in zip(batch.column(2).to_pylist(), _read(batch.column(5))):
                out.append(_digest(frames.span(0, frames.size)))
                back.append(_digest(restored(frames, form)))
            columns = [*batch.columns[:5], pa.array(out, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", *names[1:], "output_sha256", "restored_sha256"])

    kind = made.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return made.select(*names, "output").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def texts(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Output and restored text as strings: the id, ``output_text``, ``restored_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = [
                (b"".join(frames.span(0, frames.size)).decode(), b"".join(restored(frames, form)).decode())
                for form, frames in zip(batch.column(1).to_pylist(), _read(batch.column(2)))
            ]
            columns = [pa.array([b[i] for b in both], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "output_text", "restored_text"])

    kind = made.schema[id_col].dataType.simpleString()
    out = made.select(id_col, "form", "output").mapInArrow(run, f"id {kind}, output_text string, restored_text string")
    return out.withColumnRenamed("id", id_col)
