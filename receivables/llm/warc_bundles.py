"""WARC records in seekable Zstandard bundles, with an index from record ids to places inside frames.

A bundle is a ``.warc.zst`` file: WARC/1.1 records, grouped into Zstandard frames that are compressed independently of each
other, and at the end a skippable frame with the seek table (compressed and uncompressed size and checksum of every frame)
in the public seekable format, so that any Zstandard reader reads the whole file and a seeking reader a single frame. The
index, a Spark table, has for every record its id, bundle, frame, offset in the uncompressed frame and length; ``fetch``
reads single records through the footer without touching other frames.

Equal payloads are stored once. Tasks pre-aggregate by digest, so a payload that a third of all pages share reaches the
shuffle once per task, and only its response record carries the text; all other pages become revisit records, made from
narrow rows (id, url, digest), whose join to the response is salted. Texts are shuffled once at most.

Tasks write each bundle under a temporary name (leading ``_``, which readers skip) and rename it when its footer stands; the
content depends on the rows only and rows are sorted inside a partition, so a task that runs again after a lost executor
writes the same bundle over the first. The index comes from the same tasks and is committed as Parquet. Files are
written and read through pyarrow's file systems (local, HDFS, S3, GCS), in the folder that spark.checkpoint.dir names or
in one that is given.

Defined results: a null html is an empty payload; payloads under ``min_bytes`` are responses always. Among equal payloads the
smallest (page_id, url) is the response, null ids and urls last; other rows, exact repeats of that one too, revisit it, and
``refers_to`` is null where its page_id is. Line breaks and other control characters of a url are percent-encoded in the
header; a null url has no target header. A text longer than a frame has a frame of its own. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from receivables.functions.joins import lookup_join
from receivables.llm.common import written
from receivables.session import ensure_checkpoint_dir

FRAME_BYTES = 1 << 20  # uncompressed; a frame ends with the record that reaches it
BUNDLE_BYTES = 32 << 20  # compressed
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# The seekable Zstandard format and the profile of revisit records.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, page_id long, record_type string, bundle string, frame int, offset long, length long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(path)


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def record_name(page_id: int | None, digest: str, more: str = "") -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{more}>"


def record_bytes(kind: str, name: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, refers: str | None, date: str) -> bytes:
    """One WARC record; a response holds an HTTP message with the payload, a revisit no block."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    block = b""
    if kind == "response":
        head.append("Content-Type: application/http;msgtype=response")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Writes one task's bundles; ``add`` gives a record's place."""

    def __init__(self, folder: str, name: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
        self.store, self.folder = opened(folder)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.name, self.number, self.out = name, -1, None

    def _open(self) -> None:
        self.number += 1
        self.bundle = f"{self.name}-{self.number:04d}.warc.zst"
        self.store.create_dir(self.folder, recursive=True)
        self.temporary = f"{self.folder}/_{self.bundle}-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.temporary, compression=None)
        self.table: list[tuple[int, int, int]] = []
        self.chunks: list[bytes] = []
        self.size = self.compressed = 0

    def add(self, record: bytes) -> tuple[str, int, int, int]:
        if self.out is None:
            self._open()
        place = (self.bundle, len(self.table), self.size, len(record))
        self.chunks.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self._end_frame()
            if self.compressed >= self.bundle_bytes:
                self.close()
        return place

    def _end_frame(self) -> None:
        data = b"".join(self.chunks)
        packed = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxh64_intdigest(data) & 0xFFFFFFFF))
        self.compressed += len(packed)
        self.chunks, self.size = [], 0

    def close(self) -> None:
        if self.out is None:
            return
        if self.chunks:
            self._end_frame()
        entries = b"".join(struct.pack("<III", *t) for t in self.table)
        footer = struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)  # 0x80: entries carry checksums
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        self.store.move(self.temporary, f"{self.folder}/{self.bundle}")
        self.out = None


def seek_table(source, size: int) -> list[tuple[int, int, int, int]]:
    """(start in the file, compressed size, uncompressed size, checksum) of every frame, read from the footer."""
    source.seek(size - 9)
    frames, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the file")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - frames * width)
    raw, out, start = source.read(frames * width), [], 0
    for i in range(frames):
        entry = struct.unpack_from("<III" if width == 12 else "<II", raw, i * width)
        out.append((start, entry[0], entry[1], entry[2] if width == 12 else -1))
        start += entry[0]
    return out


def read_frame(source, frame: tuple[int, int, int, int]) -> bytes:
    start, packed, size, check = frame
    source.seek(start)
    data = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=size)
    if len(data) != size or check >= 0 and xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError(f"frame at {start} does not match the seek table")
    return data


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records in ``data``."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        length = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").split(":")[0]
    return int(number) if number else None


def described(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload of a record; a response's digest and
    size are computed from its payload and have to equal its headers."""
    kind = headers["WARC-Type"]
    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
    payload = None
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if (base32_digest(payload), len(payload)) != (digest, size):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    page = headers.get("X-Page-ID")
    refers = page_of(headers.get("WARC-Refers-To")) if kind == "revisit" else None
    return int(page) if page else None, headers.get("WARC-Target-URI"), size, digest, kind, refers, payload


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row per record: page_id, url, digest (hex), bytes, html (responses only), first_id, record_type and ``copy``, which
    tells equal revisits of one page apart."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    small = rows.where(F.col("bytes") < min_bytes).select("*", F.lit(None).cast("long").alias("first_id"), F.lit("response").alias("record_type"))
    rows = rows.where(F.col("bytes") >= min_bytes)
    responses = rows.groupBy("digest", "bytes").agg(F.min_by(F.struct("page_id", "url", "html"), order).alias("f"))
    responses = responses.select("f.page_id", "f.url", "f.html", "digest", "bytes", F.lit(None).cast("long").alias("first_id"), F.lit("response").alias("record_type"))

    # Revisits come from narrow rows: exact repeats are counted first, one of the smallest page's copies is the response.
    narrow = rows.groupBy("page_id", "url", "digest", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    narrow = written(narrow, "page-digests")
    first = narrow.groupBy("digest").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("__n"))
    first = written(first.select("digest", F.col("o.page_id").alias("first_id"), F.col("o.url").alias("first_url"), "__n").where(F.col("__n") > 1), "repeated-digests")
    single = narrow.where(F.col("copies") > 1).join(first.select("digest"), "digest", "left_anti").select("*", F.col("page_id").alias("first_id"), F.col("url").alias("first_url"))
    met = lookup_join(narrow, first.drop("__n"), "digest", "inner", spread="page_id", key_counts=first.select("digest", "__n"))
    met = met.unionByName(single)
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    left = F.col("copies") - is_first.cast("long")
    revisits = met.where(left > 0).select(
        "page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "bytes", "first_id", F.lit("revisit").alias("record_type"), F.explode(F.sequence(F.lit(1).cast("long"), left)).alias("copy")
    )
    return responses.unionByName(small).withColumn("copy", F.lit(0).cast("long")).unionByName(revisits)


def write_bundles(records: DataFrame, folder: str, date: str = DATE, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write ``decided`` rows as bundles into ``folder``; the written index."""

    def write(batches):
        from pyspark import TaskContext

        writer = BundleWriter(folder, f"part-{TaskContext.get().partitionId():06d}", frame_bytes, bundle_bytes)
        names = [f.split()[0] for f in INDEX.split(", ")]
        for batch in batches:
            places = []
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "bytes", "first_id", "record_type", "copy")]
            for page, url, html, hexed, size, first, kind, copy in zip(*columns, strict=True):
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                more = "" if kind == "response" else f":{hashlib.sha1((url or '').encode()).hexdigest()[:16]}:{copy}"
                name = record_name(page, digest, more)
                payload = html or b""
                record = record_bytes(kind, name, page, url, digest, size, payload, record_name(first, digest), date)
                places.append((name, page, kind, *writer.add(record)))
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*places, strict=True)) or [()] * 7, types, strict=True)], names)
        writer.close()

    ready = records.withColumn("html", F.col("html").cast("binary")).sortWithinPartitions("digest", "record_type", "page_id", "url", "copy")
    return written(ready.mapInArrow(write, INDEX), "warc-index")


def bundles(index: DataFrame, folder: str) -> DataFrame:
    """(path, length) of the bundle files that the index names, listed by Spark and dealt by size."""
    files = index.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "length")


def read_bundles(files: DataFrame) -> DataFrame:
    """All records of the bundles, one frame in memory at a time: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and payload (null for revisits)."""

    def read(batches):
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                store, at = opened(path)
                with store.open_input_file(at) as source:
                    for frame in seek_table(source, size):
                        rows = [described(*r) for r in parsed(read_frame(source, frame))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def fetch(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """(record_id, record) of the records whose ids stand in ``wanted``, each read through its bundle's footer and frame."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, at = opened(f"{folder}/{row['bundle']}")
                with store.open_input_file(at) as source:
                    frame = seek_table(source, source.size())[row["frame"]]
                    record = read_frame(source, frame)[row["offset"] : row["offset"] + row["length"]]
                yield pa.RecordBatch.from_arrays([pa.array([row["record_id"]]), pa.array([record], pa.binary())], ["record_id", "record"])

    asked = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    return asked.select("record_id", "bundle", "frame", "offset", "length").mapInArrow(read, "record_id string, record binary")


def new_folder(spark, name: str = "warc") -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, **settings) -> tuple[DataFrame, str]:
    """Write ``pages`` as bundles (``settings`` of ``write_bundles``); (index, folder)."""
    folder = folder or new_folder(pages.sparkSession)
    return write_bundles(decided(pages, min_bytes), folder, **settings), folder


def archived_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back, and describe each record."""
    index, folder = archive(pages, None, min_bytes)
    if index.isEmpty():
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_bundles(bundles(index, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST(((CAST(('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest
  FROM p
), o AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS LAST) AS n,
         first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS LAST) AS f
  FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN f END AS refers_to
FROM o
"""
