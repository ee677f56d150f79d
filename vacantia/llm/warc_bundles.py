"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole WARC records, and a seek table in a skippable frame at
its end (the public seekable format: sizes of each frame, number of frames, magic number). The index maps a record to its
bundle, frame and offset inside the unpacked frame, so one record costs the table, one frame and a slice.

Of pages with equal payloads of ``MIN_REVISIT_BYTES`` and more, the one with the largest id is written as response; the others
are revisits that keep its headers and refer to it.

Defined results: a null html is an empty payload; a null url gives no target header; rows that share the largest page_id of a
payload are all responses; a null page_id is a revisit if another page with the payload has an id, else a response; extra
columns are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from vacantia.llm.common import binary_column, open_folder

MIN_REVISIT_BYTES = 1000
#: Unpacked bytes after which a frame ends, and packed bytes after which a bundle ends.
FRAME_BYTES = 512 * 1024
BUNDLE_BYTES = 256 * 1024 * 1024
#: Parts that the rows of one payload are dealt to.
SALTS = 16

INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, bundle string, frame int, offset long")

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

_DATE = "1970-01-01T00:00:00Z"
_URL_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def with_record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, digest, refers_to (null for responses).

    Payloads found twice are a narrow table; it is repeated per salt, so that the pages of one payload, however
    many, are spread over ``SALTS`` partitions of the join.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "digest": F.sha1("html")})
    large = rows.where(F.col("payload_bytes") >= min_bytes)
    copied = large.groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    copied = copied.where((F.col("n") > 1) & F.col("last_id").isNotNull()).select(
        "digest", "last_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    is_revisit = (F.col("payload_bytes") >= min_bytes) & F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    return salted.join(copied, ["digest", "salt"], "left").select(
        "page_id", "url", "html", "payload_bytes", "digest", F.when(is_revisit, F.col("last_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_urn(refers_to)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(raw: bytes) -> dict:
    """Headers, HTTP headers and payload of one record (the payload is empty for revisits)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or not lines[0].startswith("WARC/"):
        raise ValueError("damaged record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), "payload": payload}


class BundleWriter:
    """One bundle; holds one frame of records."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.packer = sink, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.held, self.packed = [], 0, 0

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """Frame, offset in the unpacked frame, length."""
        place = len(self.frames), self.held, len(raw)
        self.buffer.append(raw)
        self.held += len(raw)
        if self.held >= FRAME_BYTES:
            self._end_frame()
        return place

    def _end_frame(self) -> None:
        packed = self.packer.compress(b"".join(self.buffer))
        self.sink.write(packed)
        self.frames.append((len(packed), self.held))
        self.packed += len(packed)
        self.buffer, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._end_frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        count, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        entries = self._read(size - 9 - count * width, count * width)
        self.frames, at = [], 0
        for k in range(count):
            packed, unpacked = struct.unpack_from("<II", entries, k * width)
            self.frames.append((at, packed, unpacked))
            at += packed

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def frame(self, k: int) -> bytes:
        at, packed, unpacked = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self._read(at, packed), max_output_size=unpacked)


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page below ``folder`` and return the index, which is written last: bundles of lost or
    repeated attempts are in no index row."""
    system, inner = open_folder(folder)
    system.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, base = open_folder(folder)
        attempt, number, writer, name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", 0, None, ""
        fields = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_pylist()
            rows = []
            for page_id, url, html, digest, refers_to in zip(
                    column("page_id"), column("url"), binary_column(batch, "html"), column("digest"), column("refers_to")):
                if writer is None:
                    name, number = f"pages-{attempt}-{number:04d}.warc.zst", number + 1
                    writer = BundleWriter(out.open_output_stream(f"{base}/{name}", compression=None))
                frame, offset, length = writer.add(record(page_id, url, html, digest, refers_to))
                rows.append((page_id, name, frame, offset, length))
                if writer.packed >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], fields)
        if writer is not None:
            writer.close()

    spark = pages.sparkSession
    with_record_types(pages).mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` rows (all, or those of some pages) point to, parsed from the bundles.

    Rows meet by frame, so each needed frame is unpacked once.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        opened, held, name, frame, data = None, None, None, None, b""
        fields = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    if held is not None:
                        held.close()
                    held = system.open_input_file(f"{base}/{row['bundle']}")
                    opened, name, frame = BundleReader(held), row["bundle"], None
                if row["frame"] != frame:
                    data, frame = opened.frame(row["frame"]), row["frame"]
                found = parse_record(data[row["offset"]:row["offset"] + row["length"]])
                rows.append(_summary(found, row))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], fields)
        if held is not None:
            held.close()

    return index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(read, RECORDS)


def _summary(found: dict, row: dict) -> tuple:
    headers = found["headers"]
    page_id, kind = _page_id(headers["WARC-Record-ID"]), headers["WARC-Type"]
    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(found["http"]["Content-Length"])
    if page_id != row["page_id"]:
        raise ValueError(f"index points to page {page_id}, not {row['page_id']}")
    if kind == "response" and (len(found["payload"]) != size or hashlib.sha1(found["payload"]).hexdigest() != digest):
        raise ValueError(f"payload of page {page_id} is damaged")
    refers = headers.get("WARC-Refers-To")
    return (page_id, size, digest, kind, _page_id(refers) if refers else None, headers.get("WARC-Target-URI"), row["bundle"], row["frame"], row["offset"])


#: The records by their definition, for the SQL check.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last_id <> page_id THEN last_id END AS refers_to
FROM k
"""
