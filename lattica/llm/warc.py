"""WARC records in seekable Zstandard bundles.

A bundle is a row with binary ``content``: independent Zstandard frames of a few records each, then a skippable frame
with the index (record id, frame, offset in the frame, length) and the seek table of the seekable format as the
footer. Any Zstandard reader decodes the content to plain WARC. Bundles are written and read by Spark as tables, so
they can lie in any store that Spark reaches, and a task that is run again replaces its own output;
:func:`export_bundles` writes them as files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.shared import shared_table, slices

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
#: Repeated digests, of under 64 bytes each, that are broadcast; beyond them the payloads move, in salted groups.
BROADCAST_DIGESTS = 100_000
SALTS = 64

# Fixed values of the Zstandard seekable format: magic numbers of its skippable frame and of its footer.
SEEK_FRAME = 0x184D2A5E
SEEK_FOOTER = 0x8F92EAB1
#: Another skippable frame, for the index.
INDEX_FRAME = 0x184D2A50

BUNDLE_SCHEMA = "bundle string, content binary"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, copy: int = 0) -> str:
    """The id of a page's record; ``copy`` tells rows apart that share a page_id, or have none."""
    name = "" if page_id is None else page_id
    return f"<urn:page:{name}:{copy}>" if copy else f"<urn:page:{name}>"


def warc_record(name: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record of the id ``name``.

    With ``refers_to``, the id of a response, it is a revisit: it has the digest and the length of its payload, but no
    block.
    """
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {refers_to}")
        lines.append(f"X-Payload-Length: {len(payload)}")
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    headers = dict(line.split(": ", 1) for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


class BundleWriter:
    """Packs records into frames, and frames with their index and seek table into one content."""

    def __init__(self, frame_bytes: int = FRAME_BYTES) -> None:
        self.frame_bytes = frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.clear()

    def clear(self) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = 0
        self.bytes = 0

    def add(self, name: str, record: bytes) -> None:
        self.index.append((name, len(self.frames), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)
        self.bytes += len(record)
        if self.open_bytes >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            plain = b"".join(self.open)
            self.frames.append(self.compressor.compress(plain))
            self.sizes.append((len(self.frames[-1]), len(plain)))
            self.open, self.open_bytes = [], 0

    def content(self) -> bytes:
        self.end_frame()
        index = self.compressor.compress(json.dumps(self.index).encode())
        index = struct.pack("<II", INDEX_FRAME, len(index)) + index
        entries = b"".join(struct.pack("<II", *size) for size in [*self.sizes, (len(index), 0)])
        footer = struct.pack("<IBI", len(self.sizes) + 1, 0, SEEK_FOOTER)
        seek = struct.pack("<II", SEEK_FRAME, len(entries) + len(footer)) + entries + footer
        out = b"".join(self.frames) + index + seek
        self.clear()
        return out


class BundleReader:
    """Finds records of a bundle by their ids, decoding only the frames that hold them."""

    def __init__(self, content: bytes) -> None:
        count, _, magic = struct.unpack("<IBI", content[-9:])
        if magic != SEEK_FOOTER:
            raise ValueError("no seek table")
        sizes = list(struct.iter_unpack("<II", content[-9 - 8 * count : -9]))
        self.content, self.at, start = content, [], 0
        for packed, plain in sizes:
            self.at.append((start, packed, plain))
            start += packed
        begin, packed, _ = self.at.pop()
        self.decompressor = zstandard.ZstdDecompressor()
        self.index = json.loads(self.decompressor.decompress(content[begin + 8 : begin + packed]))
        self.places: dict[str, tuple[int, int, int]] = {name: tuple(place) for name, *place in self.index}
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, number: int) -> bytes:
        if self.last[0] != number:
            start, packed, plain = self.at[number]
            self.last = (number, self.decompressor.decompress(self.content[start : start + packed], plain))
        return self.last[1]

    def record(self, name: str) -> bytes:
        number, offset, length = self.places[name]
        return self.frame(number)[offset : offset + length]

    def records(self) -> Iterator[bytes]:
        for _, number, offset, length in self.index:
            yield self.frame(number)[offset : offset + length]


def responses(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, copy, url, payload, digest) with ``first``: the page and copy whose response it revisits.

    ``first`` is null for responses: the smallest page_id of equal payloads, and every payload under ``min_bytes``.
    Only digests and ids are grouped. Up to BROADCAST_DIGESTS repeated digests are sent to the payloads, which don't
    move. Beyond that payloads and responses are joined by digest in up to ``SALTS`` parts, each with a copy of its
    response's id, so no task gets a whole group.
    """
    salt = F.pmod(F.xxhash64("page_id", "copy"), F.lit(SALTS)).cast("int").alias("salt")
    keys = pages.filter(F.octet_length("payload") >= min_bytes).select("page_id", "copy", "digest", salt)
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "copy")).alias("first")
    parts = keys.groupBy("digest", "salt").agg(first, F.count("*").alias("n"))
    groups = parts.groupBy("digest").agg(
        F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")
    )
    repeated = shared_table(groups.filter("n > 1").select("digest", "first", "salts"), "warc-repeated")
    if repeated.count() <= BROADCAST_DIGESTS:
        joined = pages.join(F.broadcast(repeated.select("digest", "first")), "digest", "left")
    else:
        spread = repeated.select("digest", "first", F.explode("salts").alias("salt"))
        joined = pages.withColumn("salt", salt).join(spread, ["digest", "salt"], "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("copy") == F.col("first.copy"))
    revisit = F.col("first").isNotNull() & (F.octet_length("payload") >= min_bytes) & ~is_first
    of = F.struct(F.col("first.page_id").alias("page_id"), F.col("first.copy").alias("copy"))
    return joined.select("page_id", "copy", "url", "payload", F.when(revisit, of).alias("first"))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    writer, made = BundleWriter(), 0

    def bundle() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"bundle": [f"{task:06d}-{made:06d}"], "content": [writer.content()]})

    for batch in slices(batches):
        columns = [batch.column(name) for name in ("page_id", "copy", "url", "payload", "first")]
        for page, copy, url, payload, first in zip(*columns, strict=True):
            name = record_id(page.as_py(), copy.as_py())
            of = record_id(**first.as_py()) if first.is_valid else None
            writer.add(name, warc_record(name, url.as_py(), payload.as_py(), of))
            if writer.bytes >= BUNDLE_BYTES:
                yield bundle()
                made += 1
    if writer.index:
        yield bundle()


def write_bundles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the WARC records of ``pages`` (page_id, url, html) to a shared table of bundles and return it.

    Null html is an empty payload; null page_id gives a record without a page, which never is the response of a
    payload that a page with an id has. Rows that repeat a page_id, or have none, are told apart by a copy number in
    their record ids; of those with equal payloads one is the response and the others revisit it. A payload of any
    length is one record, alone in its frame and bundle beyond their sizes. An empty table gives no bundles. Other
    columns are ignored, whatever their names.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    twice = rows.groupBy("page_id").count().filter("count > 1 OR page_id IS NULL").limit(1)
    if twice.count():  # only then rows need a number of their own
        rows = shared_table(rows.withColumn("copy", F.monotonically_increasing_id() + 1), "warc-pages")
    else:
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
    return shared_table(responses(rows, min_bytes).mapInArrow(_write, BUNDLE_SCHEMA), "warc-bundles")


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = re.compile(r"<urn:page:(-?\d*)(?::\d+)?>")

        def page(name: str | None) -> int | None:
            found = number.fullmatch(name)[1] if name else ""
            return int(found) if found else None

        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for data in BundleReader(content.as_py()).records():
                    headers, block = parse_record(data)
                    revisit = headers["WARC-Type"] == "revisit"
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and payload_digest(block) != digest:
                        raise ValueError(f"{headers['WARC-Record-ID']}: the payload doesn't have its digest")
                    rows.append(
                        {
                            "page_id": page(headers["WARC-Record-ID"]),
                            "payload_bytes": int(headers["X-Payload-Length"]) if revisit else len(block),
                            "payload_digest": digest,
                            "record_type": headers["WARC-Type"],
                            "refers_to": page(headers.get("WARC-Refers-To")),
                            "url": headers.get("WARC-Target-URI"),
                            "payload": block if with_payload and not revisit else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)

    return read


RECORD_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.binary()),
    ]
)


def read_bundles(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records in the ``content`` column of ``bundles``: a written table, or files read as ``binaryFile``.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits). The digest of
    each response is checked against its payload.
    """
    return bundles.select("content").mapInArrow(_read(with_payload), RECORD_SCHEMA)


def bundle_index(bundles: DataFrame) -> DataFrame:
    """Where each record lies: bundle, record_id, frame, offset (in the decoded frame), length."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("bundle"), batch.column("content"), strict=True):
                index = BundleReader(content.as_py()).index
                yield pa.RecordBatch.from_pylist(
                    [
                        {"bundle": name.as_py(), "record_id": r, "frame": f, "offset": o, "length": n}
                        for r, f, o, n in index
                    ]
                )

    schema = "bundle string, record_id string, frame long, offset long, length long"
    return bundles.select("bundle", "content").mapInArrow(places, schema)


def export_bundles(bundles: DataFrame, folder: str) -> None:
    """Write each bundle as ``<bundle>.warc.zst`` into ``folder``, a URI of a store that every executor reaches."""

    def save(rows) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for row in rows:
            path = f"{root}/{row['bundle']}.warc.zst"
            part = f"{path}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(part) as file:
                file.write(row["content"])
            store.move(part, path)  # whole or not at all, also if the task runs twice

    bundles.foreachPartition(save)
