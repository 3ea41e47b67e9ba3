"""Media columns: payloads by content in tar shards, metadata from their headers.

A text's bytes, padded with blanks to whole rows of pixels, are the samples of an 8-bit RGB image, stored losslessly as PNG. Tasks
append the stored forms to tar shards in the shared folder, each under the name of its digest and once a shard; a row carries
digest, shard, offset and length. Metadata columns come from range reads of the header alone; features from the stored bytes.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrid import buffers
from .runtime import new_path, prepare, stored

#: Bytes of a row of pixels; payloads are whole rows, one at least.
ROW = 192
WIDTH = ROW // 3
SHARD_BYTES = 64 << 20
LEVEL = 1
#: Bytes of a PNG up to the end of its header chunk.
HEADER = 33
_MAGIC = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes) -> bytes:
    """``data`` and blanks up to a positive multiple of ROW."""
    return data + b" " * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """The payload as an RGB image WIDTH pixels wide."""
    height = len(payload) // ROW
    lines = np.zeros((height, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 2, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(head: bytes) -> dict[str, int]:
    """Width, height, bit depth and colour type from the first HEADER bytes of a PNG."""
    if head[:8] != _MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return dict(zip(("width", "height", "bit_depth", "color_type"), struct.unpack(">IIBB", head[16:26]), strict=True))


def from_png(data: bytes) -> bytes:
    """The samples of an image made by :func:`to_png`, checked against its checksums."""
    height, at, parts = header(data)["height"], 8, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read")
    return lines[:, 1:].tobytes()


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class ShardWriter:
    """Appends payloads to tar shards of a folder; equal payloads once a shard."""

    def __init__(self, folder: str):
        self.fs, self.folder = _filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.out = None

    def add(self, data: bytes, digest: str, suffix: str = ".png") -> tuple[str, int, int]:
        """Shard name, offset and length of ``data``."""
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.name, self.at, self.seen = f"shard-{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        if digest not in self.seen:
            info = tarfile.TarInfo(digest + suffix)
            info.size = len(data)
            head = info.tobuf()
            self.out.write(head)
            self.out.write(data)
            self.out.write(b"\0" * (-len(data) % 512))
            self.seen[digest] = (self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        return (self.name, *self.seen[digest])

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


class ShardReader:
    """Range reads from the shards of a folder."""

    def __init__(self, folder: str):
        self.fs, self.folder = _filesystem(folder)
        self.open = lru_cache(maxsize=16)(lambda name: self.fs.open_input_file(f"{self.folder}/{name}"))

    def read(self, shard: str, offset: int, length: int) -> bytes:
        return self.open(shard).read_at(length, offset)


_INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = None
        for batch in batches:
            shards = shards or ShardWriter(folder)
            data, offsets = buffers(batch.column(1))
            rows = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                image = to_png(pad(data[a:b].tobytes()))
                digest = hashlib.sha256(image).hexdigest()
                rows.append((b - a, digest, *shards.add(image, digest)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shards:
            shards.close()

    return run


def write_media(docs: DataFrame, folder: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the rows' payloads to tar shards in ``folder``; the index (doc_id, n_bytes, digest, shard, offset, length), stored.

    A null or empty text is one row of blanks. Repeated rows have rows of their own and share a payload within a shard. A task that is
    run again writes new shards, and only those in the index are read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return stored(rows.mapInArrow(_writer(folder), _INDEX), "media-index")


_META = ("width", "height", "bit_depth", "color_type")


def _headers(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardReader(folder)
        for batch in batches:
            at = {k: batch.column(k).to_pylist() for k in ("shard", "offset")}
            found = [header(shards.read(s, o, HEADER)) for s, o in zip(at["shard"], at["offset"], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in found], pa.int64()) for k in _META)], names=[*batch.schema.names, *_META])

    return run


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height, bit_depth and color_type, from range reads of HEADER bytes a row."""
    return index.mapInArrow(_headers(folder), _INDEX + "".join(f", {k} long" for k in _META))


def feature(samples: bytes, meta: dict[str, int]) -> str:
    """Size, mean and a histogram of eight bins of an image's samples."""
    values = np.frombuffer(samples, np.uint8)
    bins = np.bincount(values >> 5, minlength=8)
    return f"{meta['width']}x{meta['height']};mean={int(values.sum(dtype=np.int64)) / len(values):.4f};hist=" + ",".join(map(str, bins.tolist()))


_REPORT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardReader(folder)

        @lru_cache(maxsize=4096)
        def of(shard: str, offset: int, length: int, digest: str, meta: tuple) -> tuple:
            data = shards.read(shard, offset, length)
            if hashlib.sha256(data).hexdigest() != digest:
                raise ValueError(f"{shard} at {offset} isn't {digest}")
            samples = from_png(data)
            return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), digest, feature(samples, dict(zip(_META, meta, strict=True)))

        for batch in batches:
            x = {k: batch.column(k).to_pylist() for k in batch.schema.names}
            rows = [of(*k) for k in zip(x["shard"], x["offset"], x["length"], x["digest"], zip(*(x[k] for k in _META), strict=True), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[k.split()[0] for k in _REPORT.split(", ")])

    return run


def with_features(described: DataFrame, folder: str) -> DataFrame:
    """Digests, checksum and feature of each row of an index with metadata, from the stored bytes read back."""
    return described.mapInArrow(_features(folder), _REPORT)


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """What :func:`with_features` of :func:`with_metadata` gives, in one Python worker a task: one after the other, each keeps a worker of its own."""
    describe, compute = _headers(folder), _features(folder)
    return index.mapInArrow(lambda batches: compute(describe(batches)), _REPORT)


#: Bytes of payloads that a task reads back.
READ_BYTES = 16 << 20


def dealt(index: DataFrame) -> DataFrame:
    """The index dealt by how much there is to read, in the order of the shards: the index alone is a few small files."""
    total = index.agg(F.sum("length").alias("n")).first().n or 0
    return index.repartitionByRange(max(1, -(-total // READ_BYTES)), "shard", "offset").sortWithinPartitions("shard", "offset")


def media_report(docs: DataFrame) -> DataFrame:
    """Store, describe and read back the whole texts of ``docs``; nulls, repeated rows and payloads as in :func:`write_media`, an empty table gives
    no rows, and other columns aren't read."""
    folder = new_path(docs.sparkSession, "media")
    return read_back(dealt(write_media(docs, folder)), folder)
