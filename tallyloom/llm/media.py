"""Media columns: content-addressed payloads in tar shards.

Texts become 8-bit grey PNG images, 576 samples a row. A task appends the images it makes to tar shards, each named by
the SHA-256 of its bytes and stored once in a shard, and hands on rows of digest, shard, offset and length. Payloads are
never shuffled. Metadata columns come from range reads of the first 33 bytes; features from reading all bytes back.

A shard's name is of its attempt alone, and only rows of attempts that ended are kept, so a task that is run again
writes other shards and leaves at most files that no row names. Shards lie in a folder that all machines share, on any
file system that pyarrow opens.

Defined cases: a null text counts as empty; empty texts fill one row of 255; any length is stored whole; repeated rows
name the same bytes; an empty table makes no shard; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.spill import fresh_path, written

UNIT = 576
_PNG = b"\x89PNG\r\n\x1a\n"
_HEADER = 33  # signature and the IHDR chunk
SHARD_BYTES = 128 << 20

_INDEX = "doc_id bigint, n_bytes bigint, digest string, shard string, offset bigint, length bigint"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with 255 to a positive multiple of ``UNIT``, and the bytes before padding."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: bytes, width: int = UNIT) -> bytes:
    """An 8-bit grey PNG of whole rows of ``width`` samples, unfiltered."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int, int]:
    """(width, height, depth, colour type) from the first 33 bytes; their checksum must hold."""
    if start[:8] != _PNG or start[12:16] != b"IHDR" or zlib.crc32(start[12:29]) != struct.unpack(">I", start[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", start[16:26])


def decode_png(data: bytes) -> bytes:
    """Samples of an 8-bit grey PNG as ``encode_png`` writes it; every chunk's checksum must hold."""
    width, height, depth, colour = png_header(data[:_HEADER])
    at, body = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, width + 1)
    if depth != 8 or colour != 0 or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit grey is read")
    return lines[:, 1:].tobytes()


def _tar_header(name: str, size: int) -> bytes:
    head = bytearray(512)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size),
                      (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\00000")):
        head[at : at + len(value)] = value
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


class ShardWriter:
    """Appends members to tar shards of one task; ``close`` ends the last."""

    def __init__(self, base: str, shard_bytes: int = SHARD_BYTES):
        self.store, self.root = fs.FileSystem.from_uri(base)
        self.base, self.limit, self.out = base, shard_bytes, None
        self.store.create_dir(self.root, recursive=True)

    def add(self, data: bytes) -> tuple[str, str, int, int]:
        """(digest, shard, offset, length) of ``data``, which is written if this shard lacks it."""
        digest = hashlib.sha256(data).hexdigest()
        if self.out is None or self.at > self.limit:
            self.close()
            self.name, self.at, self.seen = f"shard-{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.store.open_output_stream(f"{self.root}/{self.name}")
        if digest not in self.seen:
            self.out.write(_tar_header(digest + ".png", len(data)) + data + b"\0" * (-len(data) % 512))
            self.seen[digest] = self.at + 512
            self.at += 512 + len(data) + -len(data) % 512
        return digest, self.name, self.seen[digest], len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


class ShardReader:
    """Range reads of shards; one shard is open at a time."""

    def __init__(self, base: str):
        self.store, self.root = fs.FileSystem.from_uri(base)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            self.file, self.name = self.store.open_input_file(f"{self.root}/{shard}"), shard
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{shard} ends before {offset + length}")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = self.name = None


def store_texts(docs: DataFrame, base: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shards under ``base`` and returns the index (doc_id, n_bytes, digest, shard, offset, length) as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = None
        for b in batches:
            to = to or ShardWriter(base, shard_bytes)
            rows = []
            for text in b.column(1).to_pylist():
                samples, n = payload_of(text)
                rows.append((n, *to.add(encode_png(samples))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if to:
            to.close()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, _INDEX), "media-index")


def with_metadata(index: DataFrame, base: str) -> DataFrame:
    """Adds width, height, bit_depth and colour_type, reading 33 bytes of each payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(base)
        for b in batches:
            at = zip(b["shard"].to_pylist(), b["offset"].to_pylist(), strict=True)
            found = [png_header(reader.read(s, o, _HEADER)) for s, o in at]
            more = [pa.array([f[i] for f in found], pa.int32()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "width", "height", "bit_depth", "colour_type"])
        reader.close()

    fields = ", ".join(f"{c} {k}" for c, k in index.dtypes)
    return index.mapInArrow(run, fields + ", width int, height int, bit_depth int, colour_type int")


def features_of(media: bytes) -> tuple[int, str, int, int, str, str]:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    samples = decode_png(media)
    values = np.frombuffer(samples, dtype=np.uint8)
    quarter = np.bincount(values >> 6, minlength=4)
    edges = int((values[1:] != values[:-1]).sum())
    feature = f"png8:{UNIT}x{len(values) // UNIT}:mean={int(values.sum(dtype=np.int64)) // len(values)}:hist={'-'.join(map(str, quarter))}:edges={edges}"
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def with_features(index: DataFrame, base: str) -> DataFrame:
    """Adds what ``features_of`` finds in the stored bytes, which must have their digest."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(base)
        for b in batches:
            rows = []
            for digest, shard, offset, length in zip(*(b[c].to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                row = features_of(reader.read(shard, offset, length))
                if row[4] != digest:
                    raise OSError(f"{shard} at {offset} does not hold {digest}")
                rows.append(row)
            more = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])
        reader.close()

    fields = ", ".join(f"{c} {k}" for c, k in index.dtypes)
    return index.mapInArrow(run, fields + ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_columns(docs: DataFrame, base: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, then reads headers and payloads back."""
    base = base or fresh_path(docs.sparkSession, "media")
    index = store_texts(docs, base, id_col, text_col)
    return with_features(with_metadata(index, base), base)
