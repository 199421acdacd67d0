"""Token ids in binary files (operator 13): one frame a document, all with one trained zstandard dictionary.

A document's ids are serialised as little-endian numbers of 16 or 32 bits, the end id last, and compressed by themselves,
so that a short document is read without its neighbours; what short documents have in common is in the dictionary, which is
trained on serialised arrays first and kept once beside the shards.  Only frames are written down, ordered by id in ranges
and put into shards, one task a range.  A shard is

    MAGIC | SHA-256 of the dictionary | width of an id (1 byte) | frames | index | length of the index (8 bytes) | MAGIC

where the index is an Arrow stream of doc_id, start (ids before it in the shard), n_tokens, offset, length and crc32 of
the serialised array.  ``shards`` under the folder is a Parquet table of the shards that count, one row each with its place
in the order; shards have fresh random names, so a task that is run again never touches what a lost one wrote.
:func:`read` reads everything in order, :func:`index` the indexes alone, :func:`fetch` single documents by range reads.

The dictionary is fitted on at most SAMPLE documents of at most LONGEST ids; where these are too few to train on, it is
their arrays after one another, and for an empty table nothing.  All else covers every row.

Defined cases: a null or empty text is its end id alone; a null doc_id comes first and stays null; rows that share an id
are documents of their own, in the order of a hash of their frames; equal texts have equal frames; other columns are ignored;
an empty table gives a store without shards and an empty result; a very long text is one frame, and a shard of its own
where it is longer than a shard.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.bpe import coder, vocabulary_path
from skein.llm.common import cut_lineage, give_back, new_folder, texts
from skein.llm.media import _filesystem

MAGIC = b"IDSHARD1"
#: Bytes before the first frame, and behind the index.
HEAD, TAIL = len(MAGIC) + 33, len(MAGIC) + 8
#: The id behind each document.
END = 2
#: A shard that holds so many bytes of frames is closed; frames are read in blocks of so many bytes.
SHARD_BYTES = 64 << 20
BLOCK = 4 << 20
#: Documents, and ids of one, that the dictionary is trained on at most; its size; the level of compression.
SAMPLE = 4000
LONGEST = 2048
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

SHARDS = "part long, piece long, shard string, docs long, tokens long, dictionary string"
ENTRY = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("crc32", pa.int64())])


def serialised(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, ids, n_tokens): each text's ids as little-endian numbers, ``end`` behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in batches:
            for part, arrays, counts in _arrays(bpe, b, _width(path, end), end):
                yield pa.record_batch([part.column(0), pa.array(arrays, pa.binary()), pa.array(counts)], names=["doc_id", "ids", "n_tokens"])
        give_back()

    return texts(docs).mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def _arrays(bpe, batch: pa.RecordBatch, width: int, end: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """Slices of a batch with each text's serialised array and how many ids it has."""
    kind = f"<u{width}"
    last = np.array([end], kind).tobytes()
    for part, ids, counts in bpe.encode_batches(batch, 1, 1000):
        flat, ends = ids.astype(kind).tobytes(), (np.cumsum(counts) * width).tolist()
        yield part, [flat[s:e] + last for s, e in zip([0, *ends], ends)], counts + 1


def _width(path: str, end: int) -> int:
    return 2 if max(len(coder(path).token_bytes), end + 1) <= 1 << 16 else 4


def trained(docs: DataFrame, path: str, end: int = END) -> bytes:
    """A dictionary for serialised arrays, from a bounded sample of the rows."""
    share = min(1.0, 2 * SAMPLE / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(share * (1 << 20))
    samples = [bytes(r.ids) for r in serialised(docs.filter(drawn).limit(SAMPLE), path, end).filter(F.col("n_tokens") <= LONGEST).select("ids").collect()]
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def framed(docs: DataFrame, path: str, dictionary: bytes, end: int = END) -> DataFrame:
    """(doc_id, frame, n_tokens, crc32): each text's array as a frame, and the CRC-32 of the array.  Encoded and compressed
    in one pass, so that arrays never leave their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, frames = coder(path), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_dict_id=False)
        for b in batches:
            for part, arrays, counts in _arrays(bpe, b, _width(path, end), end):
                yield pa.record_batch([part.column(0), pa.array([frames.compress(a) for a in arrays], pa.binary()), pa.array(counts), pa.array([zlib.crc32(a) for a in arrays], pa.int64())], names=["doc_id", "frame", "n_tokens", "crc32"])
        give_back()

    return texts(docs).mapInArrow(run, "doc_id long, frame binary, n_tokens long, crc32 long")


class _Writer:
    """The shards that one task writes."""

    def __init__(self, folder: str, head: bytes) -> None:
        self.files, self.path = _filesystem(f"{folder}/files")
        self.files.create_dir(self.path, recursive=True)
        self.head, self.out, self.piece = head, None, 0

    def add(self, doc_id: int | None, frame: bytes, n_tokens: int, crc32: int) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.ids"
            self.out, self.at, self.tokens, self.entries = self.files.open_output_stream(f"{self.path}/{self.name}"), HEAD, 0, []
            self.out.write(self.head)
        self.out.write(frame)
        self.entries.append((doc_id, self.tokens, n_tokens, self.at, len(frame), crc32))
        self.at += len(frame)
        self.tokens += n_tokens

    def close(self) -> Iterator[tuple]:
        """The row of the shard that is open, if one is."""
        if self.out is not None:
            body = io.BytesIO()
            with pa.ipc.new_stream(body, ENTRY, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*self.entries), ENTRY, strict=True)], schema=ENTRY))
            self.out.write(body.getvalue() + len(body.getvalue()).to_bytes(8, "little") + MAGIC)
            self.out.close()
            self.out = None
            yield (self.piece, self.name, len(self.entries), self.tokens)
            self.piece += 1


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end: int = END) -> str:
    """Writes every whole text's ids in ascending doc_id order; the folder."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    folder = folder or new_folder(spark, "ids")
    dictionary = trained(docs, path, end)
    said = hashlib.sha256(dictionary).hexdigest()
    head = MAGIC + hashlib.sha256(dictionary).digest() + bytes([_width(path, end)])
    files, place = _filesystem(folder)
    files.create_dir(place, recursive=True)
    with files.open_output_stream(f"{place}/{said}.dictionary") as out:
        out.write(dictionary)
    held = cut_lineage(framed(docs, path, dictionary, end).withColumn("_row", F.monotonically_increasing_id()))
    size = held.agg(F.coalesce(F.sum(F.octet_length("frame")), F.lit(0)).alias("n")).first().n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part, rows = _Writer(folder, head), TaskContext.get().partitionId(), []
        for b in batches:
            for entry in zip(*(c.to_pylist() for c in b.columns), strict=True):
                writer.add(*entry)
                if writer.at >= SHARD_BYTES:
                    rows += writer.close()
        rows += writer.close()
        yield pa.record_batch([pa.array(c, k) for c, k in zip([[part] * len(rows), *(list(zip(*rows)) or [[]] * 4), [said] * len(rows)], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["part", "piece", "shard", "docs", "tokens", "dictionary"])
        give_back()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("frame"), F.col("_row")]
    dealt = held.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "frame", "n_tokens", "crc32").mapInArrow(run, SHARDS).write.parquet(f"{folder}/shards")
    return folder


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards that count, with ``base``, the ids of all shards before: one row a shard, and a window over these."""
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(SHARDS).parquet(f"{folder}/shards").withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


class _Reader:
    """One shard; ValueError for one that is damaged or of another dictionary."""

    def __init__(self, files, place: str, shard: str, said: str) -> None:
        self.file = files.open_input_file(f"{place}/files/{shard}")
        size = self.file.size()
        head, tail = self.file.read_at(HEAD, 0), self.file.read_at(TAIL, size - TAIL)
        if head[: len(MAGIC)] != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{shard} is no whole shard")
        if head[len(MAGIC) : -1].hex() != said:
            raise ValueError(f"{shard} has another dictionary")
        self.kind = f"<u{head[-1]}"
        length = int.from_bytes(tail[:8], "little")
        self.entries = pa.ipc.open_stream(self.file.read_at(length, size - TAIL - length)).read_all().combine_chunks()

    def numbers(self, frames: zstandard.ZstdDecompressor, frame: bytes, crc32: int) -> np.ndarray:
        ids = frames.decompress(frame)
        if zlib.crc32(ids) != crc32:
            raise ValueError("a frame is damaged")
        return np.frombuffer(ids, self.kind)


def _frames(files, place: str, said: str) -> zstandard.ZstdDecompressor:
    """What the dictionary of this hash has compressed."""
    with files.open_input_file(f"{place}/{said}.dictionary") as f:
        dictionary = f.read()
    if hashlib.sha256(dictionary).hexdigest() != said:
        raise ValueError("the dictionary is damaged")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))


def _spread(rows: DataFrame, spark: SparkSession, *by: str) -> DataFrame:
    return rows.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count()), *by)


READ = "doc_id long, start long, n_tokens long, ids array<int>"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _filesystem(folder)
        frames: dict[str, zstandard.ZstdDecompressor] = {}
        for b in batches:
            for shard, said, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if said not in frames:
                    frames[said] = _frames(files, place, said)
                reader = _Reader(files, place, shard, said)
                offset, length, crc = (reader.entries.column(c).to_numpy() for c in ("offset", "length", "crc32"))
                at = 0
                while at < len(offset):
                    upto = max(at + 1, int(np.searchsorted(offset + length, offset[at] + BLOCK, side="right")))
                    block = reader.file.read_at(int(offset[upto - 1] + length[upto - 1] - offset[at]), int(offset[at]))
                    ids = [reader.numbers(frames[said], block[o : o + n], c) for o, n, c in zip((offset[at:upto] - offset[at]).tolist(), length[at:upto].tolist(), crc[at:upto].tolist(), strict=True)]
                    part = reader.entries.slice(at, upto - at)
                    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                    yield pa.record_batch([part.column("doc_id").combine_chunks(), pa.array(part.column("start").to_numpy() + base), part.column("n_tokens").combine_chunks(), lists], names=["doc_id", "start", "n_tokens", "ids"])
                    at = upto
                reader.file.close()
        give_back()

    return _spread(shards(spark, folder).select("shard", "dictionary", "base", "part", "piece"), spark, "part", "piece").select("shard", "dictionary", "base").mapInArrow(run, READ)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, dictionary, start, n_tokens, offset, length and crc32 of every document: no frame is read."""
    names = ["doc_id", "shard", "dictionary", "start", "n_tokens", "offset", "length", "crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _filesystem(folder)
        for b in batches:
            for shard, said, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                reader = _Reader(files, place, shard, said)
                reader.file.close()
                e, n = reader.entries, reader.entries.num_rows
                made = [e.column("doc_id"), pa.array([shard] * n, pa.string()), pa.array([said] * n, pa.string()), pa.array(e.column("start").to_numpy() + base), *(e.column(c) for c in names[4:])]
                yield from pa.table(made, names=names).to_batches()

    rows = _spread(shards(spark, folder).select("shard", "dictionary", "base", "part", "piece"), spark, "part", "piece").select("shard", "dictionary", "base")
    return rows.mapInArrow(run, "doc_id long, shard string, dictionary string, start long, n_tokens long, offset long, length long, crc32 long")


def fetch(entries: DataFrame, folder: str) -> DataFrame:
    """The documents of some rows of :func:`index`, each by one range read of its frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _filesystem(folder)
        name, reader, frames = None, None, {}
        for b in batches:
            rows, ids = b.to_pylist(), []
            for r in rows:
                if r["dictionary"] not in frames:
                    frames[r["dictionary"]] = _frames(files, place, r["dictionary"])
                if r["shard"] != name:
                    name, reader = r["shard"], _Reader(files, place, r["shard"], r["dictionary"])
                ids.append(reader.numbers(frames[r["dictionary"]], reader.file.read_at(r["length"], r["offset"]), r["crc32"]).tolist())
            yield pa.record_batch([b.column(0), pa.array([r["start"] for r in rows], pa.int64()), pa.array([r["n_tokens"] for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids"])

    near = entries.select("doc_id", "shard", "dictionary", "start", "n_tokens", "offset", "length", "crc32").repartition("shard").sortWithinPartitions("shard", "offset")
    return near.mapInArrow(run, READ)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            flat, ends = lists.flatten().to_numpy().astype("<u4"), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).tolist()
            yield pa.record_batch([*b.columns[:3], pa.array([zlib.crc32(flat[s:e]) for s, e in zip(ends, ends[1:])], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return docs.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
