"""Media columns: Netpbm and BMP pictures as numpy arrays, area resizing by integral images, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.tables import id_and_text
from tracemill.session import materialize

#: Rows of a picture whose integral image is held at once.
BAND_ROWS = 1 << 14
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A grey picture of 8-bit samples as binary Netpbm."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A grey picture of 8-bit samples as BMP with a grey palette: rows from the bottom, padded to four bytes."""
    height, width = samples.shape
    padded = np.zeros((height, -(-width // 4) * 4), np.uint8)
    padded[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    return struct.pack("<2sIHHI", b"BM", start + padded.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, padded.size, 2835, 2835, 256, 256) + palette.tobytes() + padded.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Samples of a Netpbm (P1 to P6) or an uncompressed BMP (8, 24 or 32 bits) picture: height x width, or x 3 in colour.

    Bitmaps become 0 and 255; samples of a lower maximum are scaled to 255, those of 16 bits keep their high part. Raises ValueError for
    what is none of these or is cut short.
    """
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if re.match(rb"P[1-6]", data):
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        if not (m := _TOKEN.match(data, at)):
            raise ValueError("broken Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, top = (*numbers, 1)[:3]
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if kind <= 3:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        flat = np.array([int(x) for x in (re.findall(rb"[01]", body) if kind == 1 else body.split())[:n]], np.int64)
    elif kind == 4:
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, at + 1)[: row * height])
        flat = bits.reshape(-1, row * 8)[:, :width].reshape(-1).astype(np.int64) if len(bits) == row * height * 8 else bits[:0]
    elif top == 255:
        flat = np.frombuffer(data, np.uint8, -1, at + 1)[:n]
    else:
        flat = np.frombuffer(data[at + 1 :][: n * (1 + (top > 255))], ">u2" if top > 255 else np.uint8).astype(np.int64)
    if len(flat) != n:
        raise ValueError("Netpbm data is cut short")
    if kind in (1, 4):
        flat = (1 - flat) * 255
    elif top != 255:
        flat = flat * 255 // top
    flat = flat if flat.dtype == np.uint8 else flat.astype(np.uint8)
    return flat.reshape((height, width, 3) if depth == 3 else (height, width))


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("BMP header is cut short")
    start, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("compressed BMP")
    row = -(-width * bits // 32) * 4
    body = np.frombuffer(data, np.uint8, -1, start)[: row * abs(height)]
    if len(body) != row * abs(height):
        raise ValueError("BMP data is cut short")
    rows = body.reshape(abs(height), row)[:: -1 if height > 0 else 1]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, start - 14 - header, 14 + header).reshape(-1, 4)[:, 2::-1]
        grey = (palette == palette[:, :1]).all()
        return palette[:, 0][rows[:, :width]] if grey else palette[rows[:, :width]]
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()


def resize_area(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the samples under each cell of a height x width grid, edges weighted by their share, as float64.

    The integral image is read at the fractional grid lines by linear interpolation, which is exact for box means. Long pictures are
    taken in bands, so memory doesn't grow with them.
    """
    if samples.ndim == 3:
        samples = samples.mean(axis=2)
    h, w = samples.shape
    lines = np.linspace(0, h, height + 1)
    across = np.linspace(0, w, width + 1)
    low = np.minimum(across.astype(np.int64), w - 1)
    part = across - low
    at_lines = np.zeros((height + 1, width + 1))
    above = np.zeros(w)
    for top in range(0, h, BAND_ROWS):
        band = np.cumsum(samples[top : top + BAND_ROWS], axis=0, dtype=np.float64)
        band += above
        down = np.vstack([above, band])
        n = len(band)
        inside = np.flatnonzero((lines >= top) & (lines <= top + n))
        k = np.minimum((lines[inside] - top).astype(np.int64), n - 1)
        share = (lines[inside] - top - k)[:, None]
        columns = down[k] * (1 - share) + down[k + 1] * share
        whole = np.zeros((len(inside), w + 1))
        np.cumsum(columns, axis=1, out=whole[:, 1:])
        at_lines[inside] = whole[:, low] * (1 - part) + whole[:, low + 1] * part
        above = band[-1].copy()
    sums = at_lines[1:, 1:] - at_lines[:-1, 1:] - at_lines[1:, :-1] + at_lines[:-1, :-1]
    return sums / (h / height * (w / width))


def difference_hash(samples: np.ndarray) -> str:
    """64 bits, as 16 hex digits: whether each cell of an 8 x 9 reduction is darker than its right neighbour."""
    small = np.round(resize_area(samples, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(samples: np.ndarray, side: int) -> bytes:
    """The picture reduced to side x side 8-bit samples, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.rint(resize_area(samples, side, side)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def payload_of(text: str | None, multiple: int = 64) -> bytes:
    """A text's UTF-8 bytes, filled with zero bytes to a positive multiple."""
    data = (text or "").encode()
    return data + bytes(max(multiple, -(-len(data) // multiple) * multiple) - len(data))


def store_media(docs: DataFrame, width: int = 64, form: str = "pgm", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's payload as a grey picture `width` samples wide, in a table in the shared folder.

    A null or empty text gives one row of zero bytes; repeated rows and null ids are kept; other columns are not read.
    """
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low in ((b, k) for b in batches for k in range(0, b.num_rows, 256)):
            some = batch.slice(low, 256)
            texts = [x.as_py() for x in some.column("text")]
            media = [encode(np.frombuffer(payload_of(t, width), np.uint8).reshape(-1, width)) for t in texts]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = id_and_text(docs, id_col, text_col)
    made = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")
    return materialize(made, "media", compression="zstd")


def read_media(media: DataFrame, side: int = 16) -> DataFrame:
    """For each row of (doc_id, media) the decoded height and width, samples (binary, row by row), dhash, and tile: an NPY file of
    side x side samples. A null or broken picture gives nulls in all of these. Columns besides doc_id and media are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low in ((b, k) for b in batches for k in range(0, b.num_rows, 256)):
            some = batch.slice(low, 256)
            rows = [_features(x.as_buffer(), side) if x.is_valid else (None,) * 5 for x in some.column("media")]
            height, wide, samples, dhash, tile = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), pa.array(height, pa.int32()), pa.array(wide, pa.int32()), pa.array(samples, pa.binary()), pa.array(dhash, pa.string()), pa.array(tile, pa.binary())],
                ["doc_id", "height", "width", "samples", "dhash", "tile"],
            )

    rows = media.select("doc_id", "media")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, height int, width int, samples binary, dhash string, tile binary")


def _features(data: pa.Buffer, side: int) -> tuple:
    try:
        samples = decode(data.to_pybytes())
    except ValueError:
        return (None,) * 5
    if not samples.size:
        return (*samples.shape[:2], b"", None, None)
    return (*samples.shape[:2], samples.tobytes(), difference_hash(samples), npy_tile(samples, side))


def media_digests(docs: DataFrame, width: int = 64, tail: int = 64, side: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of stored and reread texts: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last `tail` bytes),
    media_bytes, media_sha256 and feature (difference hash, colon, SHA-256 of the NPY tile). Cases as in store_media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            for cell in batch.column("media"):
                data = cell.as_buffer().to_pybytes()
                _, _, samples, dhash, tile = _features(cell.as_buffer(), side)
                row = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-tail:]), len(data), hashlib.sha256(data).hexdigest(), f"{dhash}:{hashlib.sha256(tile).hexdigest()[:16]}")
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    stored = store_media(docs, width, id_col=id_col, text_col=text_col).select("doc_id", F.col("n_bytes"), "media")
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
