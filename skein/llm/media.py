"""Media columns (operator 1): content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit grey PNG, 64 samples wide, as a member of a tar shard that is named by
the payload's SHA-256.  Every task writes shards of its own into a folder that all executors share, each payload
once per shard, and yields index rows (digest, shard, offset, length).  Shards carry a fresh random name, so a task
that is run again never touches what an earlier attempt wrote; only shards that the committed index names count.
Readers use the index alone: :func:`headers` reads the 33 bytes of signature and image header of each member by
range, :func:`read_back` the whole member.

Defined cases: a null or empty text is 64 zero bytes; equal texts have equal values and may share a member; tables
without rows give an index without rows; rows that share an id stay separate rows; other columns are ignored; a very long
text is one member, held by its task alone; nothing is ranked, so nothing ties.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import as_bytes, new_folder, texts

WIDTH = 64
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
#: A shard that has reached this size is closed.
SHARD_BYTES = 256 << 20
#: Index rows of one read task lie within so many bytes of a shard.
READ_BYTES = 8 << 20
LEVEL = 4

INDEX = "doc_id long, n_bytes long, digest string, media_sha256 string, shard string, offset long, length long"


def payload(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _part(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of what :func:`to_png` wrote; ValueError for anything damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, height = 8, [], 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a PNG part is damaged")
        if kind == b"IHDR":
            height = struct.unpack(">II", body[:8])[1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a PNG row is filtered")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Rows, mean, deviation and mean step between neighbours, from the samples alone."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    steps = int(np.abs(np.diff(x)).sum())
    return f"{n // WIDTH}:{total / n:.4f}:{(squares / n - (total / n) ** 2) ** 0.5:.4f}:{steps / n:.4f}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Shards:
    """The tar shards that one task writes."""

    def __init__(self, folder: str) -> None:
        self.files, self.path = _filesystem(folder)
        self.files.create_dir(self.path, recursive=True)
        self.out = None

    def add(self, digest: str, media: bytes) -> tuple[str, int]:
        if self.out is not None and digest in self.members:
            return self.name, self.members[digest]
        if self.out is None or self.at >= SHARD_BYTES:
            self.close()
            self.name = f"shard-{uuid.uuid4().hex}.tar"
            self.out, self.at, self.members = self.files.open_output_stream(f"{self.path}/{self.name}"), 0, {}
        member = tarfile.TarInfo(f"{digest}.png")
        member.size = len(media)
        self.out.write(member.tobuf(tarfile.USTAR_FORMAT))
        self.out.write(media)
        self.out.write(bytes(-len(media) % 512))
        self.members[digest] = self.at + 512
        self.at += 512 + len(media) + -len(media) % 512
        return self.name, self.members[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes the shards and their index under ``folder``; the committed index (see INDEX) and the folder."""
    folder = folder or new_folder(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(f"{folder}/shards")
        try:
            for b in batches:
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                    data = payload(text)
                    digest = hashlib.sha256(data).hexdigest()
                    media = to_png(data)
                    rows.append((doc_id, len(text), digest, hashlib.sha256(media).hexdigest(), *shards.add(digest, media), len(media)))
                names = ["doc_id", "n_bytes", "digest", "media_sha256", "shard", "offset", "length"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds, strict=True)], names=names)
        finally:
            shards.close()

    texts(docs).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index"), folder


def _by_range(index: DataFrame, folder: str, read, extra: str) -> DataFrame:
    """Index rows with what ``read(file, row)`` makes of each member, in tasks of neighbouring members."""
    columns = [c.strip().split(" ")[0] for c in INDEX.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(f"{folder}/shards")
        name, file, last, value = None, None, None, None
        for b in batches:
            made = []
            for shard, offset, length in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, files.open_input_file(f"{path}/{shard}")
                if (shard, offset) != last:
                    last, value = (shard, offset), read(file, offset, length)
                made.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in zip(*made))], names=[*columns, *[x.split(" ")[0] for x in extra.split(", ")]]) if made else b.slice(0, 0)
        if file is not None:
            file.close()

    spark = index.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = index.select(*columns).repartition(parts, "shard", (F.col("offset") / READ_BYTES).cast("long")).sortWithinPartitions("shard", "offset")
    return near.filter(F.col("shard").isNotNull()).mapInArrow(run, f"{INDEX}, {extra}")


def headers(index: DataFrame, folder: str) -> DataFrame:
    """Metadata columns from the 33 header bytes of each member; sample data is not read."""

    def read(file, offset: int, length: int):
        head = file.read_at(min(HEADER_BYTES, length), offset)
        width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
        return (int(width), int(height), int(depth), int(colour))

    return _by_range(index, folder, read, "width long, height long, depth long, colour long")


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Header metadata by a range read of the header, then digests and features of the samples as they are stored."""

    def read(file, offset: int, length: int):
        head = file.read_at(min(HEADER_BYTES, length), offset)
        width, height = struct.unpack(">II", head[16:24])
        media = file.read_at(length, offset)
        samples = from_png(media)
        return (int(width), int(height), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), hashlib.sha256(media).hexdigest(), feature(samples))

    return _by_range(index, folder, read, "width long, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, stored_sha256 string, feature string")
