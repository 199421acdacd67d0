"""The suffix tree's states over whole words (operator 5): they grow with the corpus and stay spread over Spark's tasks.

The bounded tree of ``suffix_tree`` predicts a symbol; where the symbol is a class, the word within it is predicted
here.  A context is the last two or three words.  It becomes a state if it stands at least LEAST times in the training
texts before words of the class, and if these words, each left out in turn, are predicted better by MARGIN nats than by
its longest proper suffix, down to the unigram model of the class.  A state's distribution is smoothed by PULL words of
that suffix's:

    P(w | class, context) = (n(context, w) + PULL * P(w | class, suffix)) / (n(context, class) + PULL)

There is no bound on the number of states and no share of the corpus that one must hold.  All contexts that end in the
same two words before the same class are one subtree, and need nothing of any other.  So each position is sent once, to
the bucket of its subtree, where its states are counted, tested and used at once; the gains come back added up by
document.  Buckets are as many as the training tokens ask for (BUCKET each).  A subtree is at most the positions of one
word pair before one of 64 classes of less frequent words.

Words are told apart by their place in the broadcast counts; a word beyond these is told apart by 31 bits of its hash in
a context and is never predicted here (the class is then told from its other words, so distributions still add up to one).
A subtree is told apart by a 64-bit hash, of which a bucket holds the upper half, and a third word within it by 24 bits.
A position takes twelve bytes on its way: so the places of words have 24 bits, and there may be as many broadcast counts.

Defined cases: null, empty and one-word texts have no position and no gain; texts without positions, as in an empty table,
give no rows; repeated texts count each and gain alike; a very long text is as many positions as it has words; states are
kept by a threshold, so none competes with another and ties don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import give_back

LEAST = 2
MARGIN = 2.0
PULL = 2.0
#: Training tokens for which there is one bucket, the fewest buckets, and the positions and rows of one flush.
BUCKET = 1 << 21
BUCKETS = 32
FLUSH = 1 << 20
FLUSH_ROWS = 1 << 15
#: Ids of words that are not in the broadcast counts start here; the last one stands for a text's begin.
UNKNOWN = 1 << 31
START = (1 << 32) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two columns of whole numbers."""
    h = (a.astype(np.uint64) + np.uint64(1)) * _ODD ^ b.astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def unpacked(column: pa.Array) -> Iterator[bytes]:
    """The values of a column of packed ones, one at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    for packed in column:
        yield unpack(packed.as_buffer())


def positions(words: np.ndarray, symbols: np.ndarray, classes: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, subtree, third, word) of a text's words that are known and whose symbol is a class."""
    at = np.flatnonzero((words < UNKNOWN) & (symbols >= classes.start) & (symbols < classes.stop))
    padded = np.concatenate((np.full(3, START, np.uint32), words))
    subtree = _mix(_mix(padded[at + 2], padded[at + 1]), symbols[at])
    return at, subtree, _mix(padded[at], subtree) >> np.uint64(40), words[at]


def _send(coded: DataFrame, buckets: int, classes: range) -> DataFrame:
    """(bucket, batch, records): the positions of a run of rows that fall into one bucket; batch is the run's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        first, size = -1, 0

        def flush() -> Iterator[pa.RecordBatch]:
            subtree, third, word, row = (np.concatenate(c) for c in zip(*held, strict=True))
            bucket = (subtree % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            names, starts = np.unique(bucket[order], return_index=True)
            ends = np.append(starts[1:], len(order))
            upper = (subtree >> np.uint64(32)).astype("<u4")[order]
            word_and_third = (word.astype(np.uint64) | (third & np.uint64(0xFF)) << np.uint64(24)).astype("<u4")[order]
            fields = (upper, word_and_third, (third >> np.uint64(8)).astype("<u2")[order], row.astype("<u2")[order])
            records = [b"".join(f[s:e].tobytes() for f in fields) for s, e in zip(starts, ends, strict=True)]
            yield pa.record_batch([pa.array(names), pa.array([first] * len(names), pa.int64()), pa.array(records, pa.binary())], names=["bucket", "batch", "records"])

        for b in batches:
            for row, training, words, symbols in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), unpacked(b.column(2)), unpacked(b.column(3)), strict=True):
                if held and (size >= FLUSH or row - first >= FLUSH_ROWS):
                    yield from flush()
                    held, size = [], 0
                at, subtree, third, word = positions(np.frombuffer(words, "<u4"), np.frombuffer(symbols, "<u2"), classes)
                if not len(at):
                    continue
                if not held:
                    first = row
                held.append((subtree, third, word, np.full(len(at), (row - first) * 2 + training, np.uint16)))
                size += len(at)
        if held:
            yield from flush()
        held = []
        give_back()

    return coded.select("row", "training", "words", "symbols").mapInArrow(run, "bucket int, batch long, records binary")


def gains(state: np.ndarray, word: np.ndarray, training: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """P(word | longest state) of each position, where ``parent`` is that of the context's suffix."""
    names, state = np.unique(state, return_inverse=True)
    pair = np.unique(state.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64), return_inverse=True)[1]
    seen, total = np.bincount(pair, training)[pair], np.bincount(state, training)[state]
    left_out = np.log((np.maximum(seen - 1, 0) + PULL * parent) / (np.maximum(total - 1, 0) + PULL) / parent)
    kept = (np.bincount(state, left_out * training, len(names)) > MARGIN)[state] & (total >= LEAST)
    return np.where(kept, (seen + PULL * parent) / (total + PULL), parent)


def word_gains(coded: DataFrame, within: np.ndarray, tokens: int, classes: range) -> DataFrame:
    """(row, deep): what the states add to a row's log10 probability; rows without any are left out.

    ``coded`` is written down and has row (consecutive within a partition), training, words and symbols; ``within`` is
    P(word | class, known) by the word's place."""
    buckets = max(BUCKETS, tokens // BUCKET)
    sent = coded.sparkSession.sparkContext.broadcast(within)

    def subtrees(group: pa.Table) -> pa.Table:
        batches, records = group["batch"].to_pylist(), group["records"].to_pylist()
        sizes = np.array([len(r) // 12 for r in records])
        columns = []
        for kind, offset in (("<u4", 0), ("<u4", 4), ("<u2", 8), ("<u2", 10)):
            columns.append(np.concatenate([np.frombuffer(r, kind, n, offset * n) for r, n in zip(records, sizes.tolist(), strict=True)]))
        upper, word, third, row = columns
        third, word = third.astype(np.uint64) << np.uint64(8) | word >> 24, word & 0xFFFFFF
        training, row = (row & 1).astype(np.float64), row >> 1
        unigram = sent.value[word]
        two = gains(upper, word, training, unigram)
        three = gains(upper.astype(np.uint64) << np.uint64(32) | third, word, training, two)
        gain = np.log10(three / unigram)
        out, start = [], 0
        for batch, n in zip(batches, sizes.tolist(), strict=True):
            sums = np.bincount(row[start : start + n], gain[start : start + n])
            some = np.flatnonzero(sums)
            out.append((batch, some.astype("<u2").tobytes(), sums[some].astype("<f4").tobytes()))
            start += n
        del columns, upper, word, third, row, training, unigram, two, three, gain
        give_back()
        return pa.table(dict(zip(("batch", "rows", "gains"), (pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()), strict=True)), strict=True)))

    def together(group: pa.Table) -> pa.Table:
        batch = group["batch"][0].as_py()
        at = np.frombuffer(b"".join(group["rows"].to_pylist()), "<u2")
        sums = np.bincount(at, np.frombuffer(b"".join(group["gains"].to_pylist()), "<f4"))
        some = np.flatnonzero(sums)
        return pa.table({"row": pa.array(batch + some, pa.int64()), "deep": pa.array(sums[some], pa.float64())})

    partial = _send(coded, buckets, classes).groupBy("bucket").applyInArrow(subtrees, "batch long, rows binary, gains binary")
    return partial.filter(F.length("rows") > 0).groupBy("batch").applyInArrow(together, "row long, deep double")
