"""Media columns: byte payloads as PNG images in binary columns, and perceptual hashes of them.

A payload becomes an 8-bit greyscale image 64 samples wide: header, image data deflated by zlib and cut
into IDAT chunks, end mark, each chunk with its CRC-32. Reading checks the signature, every chunk's
CRC and zlib's Adler sum, undoes the row filters and returns the samples. The encoder writes the filters
none, sub and up, which numpy undoes for runs of rows at a time; average and Paeth, which only foreign
images have, depend on the sample just restored and go byte by byte. The perceptual hash shrinks the image to 32 x 32 by area
means and keeps, for each of the 63 lowest frequencies of its two-dimensional cosine transform but the
constant, whether it lies above their median; it is stored as 8 bytes.

Everything is row by row: no shuffle, and memory is that of a few documents at a time.

Edge cases: null text counts as empty, and an empty text is one row of 64 zero bytes; equal texts give
equal media and hashes; null ids are carried; a text of any length becomes one image, which its task
holds whole; repeated rows are stored once each; damaged media raise ``ValueError``; an empty table gives
an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import whole

WIDTH = 64
CHUNK = 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
BATCH_ROWS = 64


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit if data else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 4) -> bytes:
    """The rows' filter (none, sub or up) is the one with the smallest sum of absolute differences."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = np.hstack([np.zeros((len(rows), 1), np.uint8), rows[:, :-1]])
    above = np.vstack([np.zeros((1, width), np.uint8), rows[:-1]])
    tried = [rows, rows - left, rows - above]
    best = min(range(3), key=lambda k: int(np.abs(tried[k].view(np.int8).astype(np.int16)).sum()))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = best, tried[best]
    data = zlib.compress(lines.tobytes(), level)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples from filtered rows (first column: filter type), one byte a sample."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for start, stop in zip([0, *edges], [*edges, len(lines)], strict=True):
        if start == stop:
            continue
        kind, block = int(kinds[start]), out[start:stop]
        above = out[start - 1] if start else np.zeros(out.shape[1], np.uint8)
        if kind == 1:
            np.cumsum(block, axis=1, dtype=np.uint8, out=block)
        elif kind == 2:
            block[0] += above
            np.cumsum(block, axis=0, dtype=np.uint8, out=block)
        elif kind in (3, 4):
            for row in block:
                left = upper_left = 0
                for i, x in enumerate(row.tolist()):
                    up = int(above[i])
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - upper_left
                        a, b, c = abs(p - left), abs(p - up), abs(p - upper_left)
                        guess = left if a <= b and a <= c else up if b <= c else upper_left
                    left, upper_left = (x + guess) & 255, up
                    row[i] = left
                above = row
        elif kind:
            raise ValueError(f"unknown row filter {kind}")
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The samples (rows x width) of an 8-bit greyscale image, with all checksums tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at, data, shape, ended = 8, [], None, False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("a chunk is cut short")
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body, crc = media[at + 8 : at + 8 + size], media[at + 8 + size : at + 12 + size]
        if len(body) != size or struct.pack(">I", zlib.crc32(kind + body)) != crc:
            raise ValueError(f"checksum of {kind!r} differs")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale without interlace is read")
            shape = (height, width)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not shape or not ended:
        raise ValueError("header or end mark is missing")
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(lines) != shape[0] * (shape[1] + 1):
        raise ValueError("image data has another size than the header says")
    return unfilter(lines.reshape(shape[0], shape[1] + 1))


def _shrunk(samples: np.ndarray, axis: int, to: int) -> np.ndarray:
    """Area means along an axis; fewer samples than ``to`` are repeated."""
    n = samples.shape[axis]
    edges = np.arange(to) * n // to
    if n < to:
        return np.take(samples, edges, axis)
    return np.add.reduceat(samples, edges, axis) / np.diff([*edges, n]).reshape((-1, 1) if axis == 0 else (1, -1))


_K = np.arange(32)
_DCT = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:8, None] / 64)


def cosine_hash(samples: np.ndarray) -> bytes:
    small = _shrunk(_shrunk(samples.astype(np.float64), 0, 32), 1, 32)
    low = np.round((_DCT @ small @ _DCT.T).ravel(), 6)
    return np.packbits(np.concatenate([[False], low[1:] > np.median(low[1:])])).tobytes()


def _schema(docs: DataFrame, id_col: str, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(n, t) for n, t in fields]])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded), media (PNG bytes)."""
    schema = _schema(docs, id_col, [("n_bytes", T.LongType()), ("media", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                data = part["data"].to_pylist()
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(d) for d in data], pa.int64()), pa.array([encode_png(padded(d)) for d in data], pa.binary())], schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).cast("binary").alias("data")).mapInArrow(encode, schema)


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """doc_id, n_bytes, media, payload (read back) and hash (8 bytes); checks every checksum."""
    schema = _schema(media, "doc_id", [("n_bytes", T.LongType()), ("media", T.BinaryType()), ("payload", T.BinaryType()), ("hash", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                images = [decode_png(m) for m in part["media"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_bytes"], part["media"], pa.array([i.tobytes() for i in images], pa.binary()), pa.array([cosine_hash(i) for i in images], pa.binary())], schema.names)

    return media.select("doc_id", "n_bytes", F.col(media_col).alias("media")).mapInArrow(decode, schema)


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of the stored and re-read media, native on top of :func:`read_media`."""
    back = read_media(to_media(docs))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )
