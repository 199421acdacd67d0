"""Packing (operator 8): sequences filled by lexical retrieval.

Texts become token ids, each text with an end id behind it.  Documents are dealt into shards of bounded size by a
lexical key, the least hashes of their rarer ids, so that those with many ids in common meet whatever file they came
from; a range of keys is split wherever it is too long, a group of copies too.  Each shard has a BM25 inverted index
over token ids, with document frequencies and the mean length of the whole corpus.  A window starts with the rest of the
document that the last window cut, or with the next unused document, its seed; the index returns the seed's nearest
unused documents, and they fill the window greedily, those that fit whole before one that has to be cut.  When these are
used up the index is asked again; only a seed that shares no term with any unused document leaves the window to the next
unused document.  So all sequences are full but for what remains at a shard's end, which is laid out in sequences whose
lengths are powers of two, and nothing is padded.

Defined cases: a null or empty text is its end id alone; ties in score go to the earlier document of the shard; repeated
rows, equal ids included, are documents of their own, each with its pieces from 0 on; other columns are ignored; an empty table gives an empty result; a very long text
passes through as many windows as it fills, and is a shard of its own where it has over SHARD_TOKENS ids.  Sequence ids
are unique but not consecutive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bpe import coder, vocabulary_path
from skein.llm.common import cut_lineage, give_back, texts

WINDOW = 2048
END = 1
#: Bounds of a shard.
SHARD_DOCS = 4096
SHARD_TOKENS = 6_000_000
#: Ids from here on make the lexical key: a vocabulary numbers its tokens from frequent to rare.
RARER = 1000
#: The seed's terms that are looked up, and the neighbours that come back.
QUERY_TERMS = 16
NEIGHBOURS = 24
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, first, second): little-endian ids, 16 bits each where the vocabulary allows it, the end id last,
    and the lexical key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        kind = _id_type(path)
        end = np.array([END], kind).tobytes()
        for b in batches:
            for part, ids, counts in bpe.encode_batches(b, 1, 1000):
                flat, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                ends = (np.cumsum(counts) * width).tolist()
                yield pa.record_batch([part.column(0), pa.array([flat[s:e] + end for s, e in zip([0, *ends], ends)], pa.binary()), *(pa.array(k) for k in lexical_key(ids, counts))], names=["doc_id", "ids", "first", "second"])
        give_back()

    return texts(docs).mapInArrow(run, "doc_id long, ids binary, first long, second long")


def lexical_key(ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For texts with ``counts`` ids each, after one another: the least of two hashes of their ids from RARER on."""
    ends = np.cumsum(counts) + np.arange(1, len(counts) + 1)
    found = []
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        hashes = np.where(ids >= RARER, (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(factor) >> np.uint64(1), np.uint64(2**63 - 1)).astype(np.int64)
        # A largest value behind each text keeps texts without ids in place.
        padded = np.insert(hashes, np.cumsum(counts), 2**63 - 1)
        found.append(np.minimum.reduceat(padded, ends - counts - 1) if len(counts) else np.zeros(0, np.int64))
    return found


def _id_type(path: str) -> str:
    return "<u2" if len(coder(path).token_bytes) <= 1 << 16 else "<u4"


def frequencies(tokens: DataFrame, path: str) -> tuple[np.ndarray, int, float]:
    """Documents that hold each id (as many numbers as the vocabulary has), documents, and mean length: of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, kind = len(coder(path).token_bytes), _id_type(path)
        held, docs, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            for ids in b.column(0).to_pylist():
                x = np.frombuffer(ids, kind)
                held[np.unique(x)] += 1
                docs, total = docs + 1, total + len(x)
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(np.concatenate((at, [-1, -2]))), pa.array(np.concatenate((held[at], [docs, total])))], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows["id"].to_pylist(), rows["n"].to_pylist()))
    docs, total = found.pop(-1, 0), found.pop(-2, 0)
    held = np.zeros(max([*found, 0]) + 1, np.int64)
    held[list(found)] = list(found.values())
    return held, docs, total / max(1, docs)


class Bm25Shard:
    """Inverted index of one shard: postings by term, weights with the corpus's frequencies."""

    def __init__(self, docs: list[np.ndarray], held: np.ndarray, n_docs: int, mean: float) -> None:
        self.n = len(docs)
        kinds = [np.unique(d, return_counts=True) for d in docs]
        sizes = np.array([len(k[0]) for k in kinds])
        term = np.concatenate([k[0] for k in kinds]).astype(np.int64)
        count = np.concatenate([k[1] for k in kinds]).astype(np.float64)
        doc = np.repeat(np.arange(self.n), sizes)
        idf = np.log1p((n_docs - held[term] + 0.5) / (held[term] + 0.5))
        length = np.array([len(d) for d in docs], np.float64)[doc]
        weight = idf * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))
        self.query = []
        for s, e in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
            top = np.argsort(-weight[s:e], kind="stable")[:QUERY_TERMS]
            self.query.append(term[s:e][top])
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.terms, self.begin = np.unique(term[order], return_index=True)
        self.end = np.append(self.begin[1:], len(order))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents by falling BM25 score for the seed's weightiest terms."""
        at = np.searchsorted(self.terms, self.query[seed])
        spans = [slice(self.begin[k], self.end[k]) for k in at]
        docs, weights = np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans])
        scores = np.bincount(docs, weights, self.n) * unused
        scores[seed] = 0
        best = np.flatnonzero(scores)
        if len(best) > NEIGHBOURS:
            last = -np.partition(-scores[best], NEIGHBOURS - 1)[NEIGHBOURS - 1]
            above, equal = best[scores[best] > last], best[scores[best] == last]
            best = np.concatenate((above, equal[: NEIGHBOURS - len(above)]))
        return best[np.lexsort((best, -scores[best]))]


def fill(lengths: list[int], neighbours, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset): pieces in order.  neighbours(seed, unused): ranked documents."""
    unused = np.ones(len(lengths), bool)
    left = sum(lengths)
    size, sequence, offset, following = min(window, _power(left, window)), 0, 0, 0
    seed, ranked, rest = None, [], None
    while left:
        if rest is None:
            if seed is None:
                while not unused[following]:
                    following += 1
                doc = seed = following
                unused[doc] = False
                ranked = None
            else:
                ranked = [d for d in ranked or () if unused[d]] or neighbours(seed, unused).tolist()
                if not ranked:
                    seed = None
                    continue
                doc = next((d for d in ranked if lengths[d] <= size - offset), ranked[0])
                unused[doc] = False
            rest = (doc, 0)
        doc, start = rest
        length = min(lengths[doc] - start, size - offset)
        yield doc, start, length, sequence, offset
        left, offset, start = left - length, offset + length, start + length
        rest = (doc, start) if start < lengths[doc] else None
        if offset == size:
            sequence, offset, size = sequence + 1, 0, _power(left, window)
            seed, ranked = (rest[0], None) if rest else (None, [])


def _power(left: int, window: int) -> int:
    """The next sequence's length: a full window, or the largest power of two that the remaining tokens fill."""
    return window if left >= window else 1 << max(0, left.bit_length() - 1)


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces (see PIECES): little-endian unsigned 32-bit ids, the document's length, and their place."""
    from pyspark import TaskContext

    path = path or vocabulary_path()
    tokens = cut_lineage(tokenise(docs, path))
    dealt = tokens.repartitionByRange("first", "second", "doc_id").sortWithinPartitions("first", "second", "doc_id", F.xxhash64("ids")).select("doc_id", "ids")
    statistics = tokens.sparkSession.sparkContext.broadcast(frequencies(tokens, path))

    def shards(batches: Iterator[pa.RecordBatch], kind: str):
        ids, held, size = [], [], 0
        for b in batches:
            for doc_id, binary in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(binary, kind)
                if held and (len(held) >= SHARD_DOCS or size + len(x) > SHARD_TOKENS):
                    yield ids, held
                    ids, held, size = [], [], 0
                ids.append(doc_id)
                held.append(x)
                size += len(x)
        if held:
            yield ids, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, mean = statistics.value
        first = TaskContext.get().partitionId() << 40
        for ids, docs_of in shards(batches, _id_type(path)):
            index = Bm25Shard(docs_of, held, n_docs, mean)
            lengths = [len(d) for d in docs_of]
            rows, used = [], 0
            for doc, start, length, sequence, offset in fill(lengths, index.neighbours):
                rows.append((ids[doc], start, docs_of[doc][start : start + length].astype("<u4").tobytes(), lengths[doc], first + sequence, offset))
                used = sequence + 1
                if len(rows) == 2000:
                    yield _pieces(rows)
                    rows = []
            if rows:
                yield _pieces(rows)
            first += used
            del index
        give_back()

    return dealt.mapInArrow(run, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])


def placed(pieces: DataFrame) -> DataFrame:
    """The pieces by length and checksum of their ids."""
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
