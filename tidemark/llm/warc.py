"""Zstandard WARC archives: one frame per record, with a shared dictionary in the leading skippable frame.

Writers put archives of bounded size into a shared folder, under names of their own, so a repeated task
never touches another's file; only files named by the manifest, which finished tasks return, are read.
The reader streams an archive: it loads the dictionary, decodes frame by frame and checks every record's
version line, mandatory headers, lengths and digests. An archive that does not hold what it says raises.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.scratch import materialise, scratch_path

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: An archive is closed once it is so long.
ARCHIVE_BYTES = 32 << 20
#: Documented bounds of the dictionary: payloads sampled, bytes of each, and its size.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8_192, 65_536
LEVEL = 3

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
NO_DATE = "1970-01-01T00:00:00Z"

_ID = re.compile(r"<urn:page:(-?\d*)>")


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; where they are too few to train on, their plain beginning."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (HTTP + b"".join(samples))[:DICTIONARY_BYTES]


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit carries the HTTP head only, but names size and digest of its payload."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    block = HTTP + (payload if refers_to is None else b"")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", NO_DATE),
        ("WARC-Target-URI", re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(size)),
    ]
    if refers_to is not None:
        headers += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", IDENTICAL)]
    headers.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


class Writer:
    """Appends records to one archive; ``close`` gives its length."""

    def __init__(self, out: BinaryIO, dictionary: bytes):
        self.out, self.length, self.records = out, 0, 0
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True).compress
        self._put(DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.length += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.compress(data))
        self.records += 1


def frames(source: BinaryIO, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Decoded frames of an archive, one after another; memory is bounded by the largest."""
    head = source.read(8)
    if len(head) < 8 or int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    size = int.from_bytes(head[4:], "little")
    dictionary = source.read(size)
    if len(dictionary) != size:
        raise ValueError("the dictionary frame is cut short")
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    rest = source.read(chunk)
    while rest:
        frame, parts = decoder.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data or source.read(chunk)
                break
            rest = source.read(chunk)
            if not rest:
                raise ValueError("the last frame is cut short")
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Validate one record: ``page_id, payload_bytes, payload_digest, record_type, refers_to, payload``."""
    head, split, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not split or version != VERSION:
        raise ValueError(f"not a record: {data[:40]!r}")
    headers = {}
    for line in lines:
        key, colon, value = line.decode().partition(": ")
        if not colon or key in headers:
            raise ValueError(f"bad header {line!r}")
        headers[key] = value
    if missing := [k for k in MANDATORY if k not in headers]:
        raise ValueError(f"headers missing: {missing}")
    length = int(headers["Content-Length"])
    block = rest[:length]
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest)} bytes, but Content-Length {length}")
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest differs")
    payload = block.partition(b"\r\n\r\n")[2]
    size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda s: int(m[1]) if (m := _ID.fullmatch(s)) and m[1] else None
    kind, refers = headers["WARC-Type"], None
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload differs from its length or digest")
    elif kind == "revisit":
        refers = number(headers["WARC-Refers-To"])
        if payload or refers is None or headers.get("WARC-Profile") != IDENTICAL:
            raise ValueError("bad revisit")
    else:
        raise ValueError(f"unexpected record type {kind}")
    return {
        "page_id": number(headers["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": refers, "payload": payload,
    }


def planned(pages: DataFrame) -> DataFrame:
    """Pages with ``bytes``, ``digest`` and ``refers_to``: the page whose payload a record repeats, or null.

    Payloads of at least ``LEAST_REVISIT`` bytes meet on their digest: the smallest id is found with
    partial aggregation, and a payload that many pages share is a skewed join that Spark splits. Shorter
    payloads have keys of their own and never meet.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha2(F.col("html").cast("binary"), 256)})
    large = F.col("bytes") >= LEAST_REVISIT
    first = base.filter(large).groupBy(F.col("digest").alias("key")).agg(F.min("page_id").alias("first"))
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.col("digest"))))
    joined = base.withColumn("key", key).join(first, "key", "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))  # a page without an id revisits too
    return joined.select("page_id", "url", "bytes", "digest", refers.alias("refers_to"), F.when(refers.isNull(), F.col("html")).alias("html"))


def write_archives(plan: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the planned records; the manifest (``path, records, length``) is itself written to scratch.

    ``folder`` is a path or URI that every executor reaches through ``pyarrow.fs``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        writer, out, name, done = None, None, "", []

        def close() -> None:
            out.close()
            done.append((f"{name}", writer.records, writer.length))

        for batch in slices(batches):
            for row in batch.to_pylist():
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{base}/{name}")
                    writer = Writer(out, dictionary)
                payload = (row["html"] or "").encode()
                writer.add(record(row["page_id"], row["url"], payload, row["bytes"], row["digest"], row["refers_to"]))
                if writer.length >= archive_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "length"])

    return materialise(plan.mapInArrow(run, "path string, records long, length long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the archives, validated, one archive at a time per task."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
         ("refers_to", pa.int64()), ("payload", pa.binary())][: len(names)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, n = [], 0
                with store.open_input_stream(f"{base}/{name}") as source:
                    for data in frames(source):
                        n += 1
                        rows.append(parse(data))
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema)
                            rows = []
                if n != expected:
                    raise ValueError(f"{name} holds {n} records, not {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema)

    kinds = {"page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}
    archives = max(1, manifest.count())
    return manifest.select("path", "records").repartition(archives).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record for every row of ``pages`` and read the archives back: one row per page.

    Columns: ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Null html is an empty
    payload; a null url is an empty target; white space in a url is escaped. Null ids stay null and
    are never referred to, except that rows of one payload that all lack an id are all responses. Rows
    that repeat a page are records of their own, all responses where theirs is the smallest id. Further
    columns are ignored; an empty table gives no archives and an empty result.
    """
    spark = pages.sparkSession
    # Ids are drawn first, so that what each task sends on are numbers; the few texts are fetched by them.
    drawn = pages.filter(F.length("html") > 0).select(F.col("page_id").alias("_drawn")).orderBy(F.xxhash64("_drawn"), "_drawn").limit(SAMPLE_ROWS)
    sample = (
        pages.join(F.broadcast(drawn.distinct()), F.col("page_id") == F.col("_drawn"), "left_semi")
        .select("page_id", F.substring("html", 1, SAMPLE_BYTES).alias("html")).limit(SAMPLE_ROWS).collect()
    )
    dictionary = train([(r["html"] or "").encode() for r in sorted(sample, key=lambda r: (r["page_id"], r["html"] or ""))])
    folder = scratch_path(spark, "archives")
    return read_archives(write_archives(planned(pages), folder, dictionary), folder)
