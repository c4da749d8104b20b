"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, and a bundle ends with a seek table: a skippable frame that lists the compressed
and plain size of every frame. A record is found by its bundle, its frame, and its offset in the frame's plain bytes, so reading one costs
one frame. The index of records and frames is a table that the writing job returns; only bundles that it names count, so what a lost
task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import checkpoint_dir, materialize

#: Plain bytes of a frame and compressed bytes of a bundle that close it.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 25
#: Fixed values of the seekable format: a skippable frame's magic number, and the seek table's own at its end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
_INDEX = "bundle string, frame int, frame_at long, frame_bytes long, plain_bytes long, record_id string, record_at long, record_bytes long, page_id string"


def record_id(page_id: str | None) -> str:
    """The record's identifier, the same at each run."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, 'page:' + page_id if page_id is not None else 'page')}>"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or with `refers_to` a revisit record, which has the HTTP head only."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_plain(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {_plain(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        *([f"X-Page: {_plain(page_id)}"] if page_id is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _plain(value: str | None) -> str:
    return "".join(c if c.isprintable() else "%" + format(ord(c), "02X") for c in value or "")


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header and block of each record in a frame's plain bytes. Raises ValueError for broken ones."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        header = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        begin = end + 4
        stop = begin + int(header["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield at, stop + 4 - at, header, data[begin:stop]
        at = stop + 4


@lru_cache(8)
def _files(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder URI, as Hadoop or plain Python writes it."""
    scheme, colon, rest = folder.partition(":")
    if colon and not rest.startswith("//"):
        folder = f"{scheme}://{rest}"
    return fs.FileSystem.from_uri(folder) if colon else (fs.LocalFileSystem(), folder)


class BundleWriter:
    """Writes one bundle; `add` collects records into frames, `close` ends it with the seek table and returns the index rows."""

    def __init__(self, folder: str, name: str, frame_bytes: int, level: int = 3):
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        self.name, self.out, self.frame_bytes = name, files.open_output_stream(f"{root}/{name}", compression=None), frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.rows: list[tuple] = []
        self.held: list[bytes] = []
        self.waiting: list[tuple[str, int, int, str | None]] = []
        self.plain = self.at = 0

    def add(self, name: str, data: bytes, page_id: str | None) -> None:
        self.waiting.append((name, self.plain, len(data), page_id))
        self.held.append(data)
        self.plain += len(data)
        if self.plain >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.rows += [(self.name, len(self.frames), self.at, len(packed), self.plain, *w[:3], w[3]) for w in self.waiting]
            self.frames.append((len(packed), self.plain))
            self.at += len(packed)
            self.held, self.waiting, self.plain = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return self.rows


def seek_table(folder: str, bundle: str) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, plain bytes) of each frame, from the end of a bundle."""
    files, root = _files(folder)
    with files.open_input_file(f"{root}/{bundle}") as f:
        size = f.size()
        count, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{bundle} has no seek table")
        table = f.read_at(8 * count, size - 9 - 8 * count)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(folder: str, bundle: str, at: int, packed: int) -> bytes:
    """Plain bytes of one frame."""
    files, root = _files(folder)
    with files.open_input_file(f"{root}/{bundle}") as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(packed, at))


def read_record(folder: str, bundle: str, frame: int, record_at: int, record_bytes: int) -> tuple[dict[str, str], bytes]:
    """Header and block of one record, found by the bundle's own seek table."""
    at, packed, _ = seek_table(folder, bundle)[frame]
    _, _, header, block = next(parse_records(read_frame(folder, bundle, at, packed)[record_at : record_at + record_bytes]))
    return header, block


def with_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, digest and refers_to of each page: of pages with equal payloads of `least_bytes` or more, the
    smallest page_id stands for all; the others refer to it. Rows that repeat the smallest id refer to nothing, as do those with a null id
    where no other id is there. A null page is an empty payload.

    The smallest ids come from digests, summed up before the shuffle. Payloads are shuffled by page, never by digest, so a page with many
    copies does no harm.
    """
    payload = F.encode(F.coalesce(pages[html_col], F.lit("")), "UTF-8")
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    keys = rows.select("page_id", "digest", "payload_bytes").where(F.col("payload_bytes") >= least_bytes)
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 AND refers_to IS NOT NULL").drop("copies")
    copies = keys.select("page_id", "digest").distinct().join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    copies = copies.select(F.col("page_id").alias("copy_id"), F.col("digest").alias("copy_digest"), "refers_to")
    same = rows["page_id"].eqNullSafe(copies["copy_id"]) & (rows["digest"] == copies["copy_digest"])
    return rows.join(copies, same, "left").drop("copy_id", "copy_digest")


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes (page_id, url, payload, refers_to) as bundles in `folder`, which all executors share; returns the index, one row per record:
    bundle, frame, frame_at, frame_bytes, plain_bytes (of the frame), record_id, record_at and record_bytes (in the frame's plain bytes),
    page_id as text. The index is stored, so that bundles are written once.

    A task writes bundles of its own with fresh names; a repeated task writes others, and only those of the successful one are in the index.
    """
    rows = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _INDEX.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        batch_of = lambda made: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names)
        writer = None
        for batch in batches:
            for page, url, payload, refers in zip(*batch.columns, strict=True):
                writer = writer or BundleWriter(folder, f"bundle-{uuid.uuid4().hex}.warc.zst", frame_bytes)
                page, data = page.as_py(), payload.as_py()
                writer.add(record_id(page), record(page, url.as_py(), data, payload_digest(data), refers.as_py(), date), page)
                if writer.at >= bundle_bytes:
                    yield batch_of(writer.close())
                    writer = None
        if writer:
            yield batch_of(writer.close())

    return materialize(rows.mapInArrow(run, _INDEX), "warc-index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """page_id (as text), payload_bytes, payload_digest, record_type and refers_to (as text) of each record of the bundles in the index,
    read back frame by frame. A response's payload is measured and hashed anew and must have the digest its header tells."""
    frames = index.select("bundle", "frame_at", "frame_bytes").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, n, digest, kind, refers = [], [], [], [], []
                for _, _, header, block in parse_records(read_frame(folder, bundle, at, size)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    told = header["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(head.rpartition(b"Content-Length: ")[2])
                    if header["WARC-Type"] == "response":
                        if payload_digest(payload) != told or len(payload) != length:
                            raise ValueError(f"{header['WARC-Record-ID']} in {bundle} is damaged")
                    page.append(header.get("X-Page"))
                    n.append(length)
                    digest.append(told)
                    kind.append(header["WARC-Type"])
                    refers.append(header.get("X-Refers-To-Page"))
                yield pa.RecordBatch.from_arrays([pa.array(page, pa.string()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array(refers, pa.string())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return frames.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per page and reads the archives back: page_id, payload_bytes, payload_digest, record_type and refers_to, ids in the
    type of the pages. `folder` is a new one in the shared folder unless given. An empty table writes nothing and gives no rows; other
    columns are not read."""
    folder = folder or f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = write_bundles(with_revisits(pages, least_bytes, id_col, url_col, html_col), folder)
    kind = pages.schema[id_col].dataType
    return read_bundles(index, folder).withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM h),
v AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(hex, 1 + 5 * g, 5))::INTEGER) AS fives FROM g)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(fives, lambda x: concat(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x >> 15) % 32, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x >> 10) % 32, 1),
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x >> 5) % 32, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + x % 32, 1))), '') AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM v"""
