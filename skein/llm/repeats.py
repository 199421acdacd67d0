"""Repeated passages (operator 2): prefix-free parsing and suffix order of the dictionary, as Spark jobs.

Every byte inside a string of LENGTH bytes that also starts anywhere else in the corpus is removed.

1. Parse.  A rolling hash runs over each text; the trigger of a LENGTH-byte string is the place of the smallest
   hash in it.  Unlike a trigger by modulus it can't be missing from a string.  A run of string starts with one
   trigger is a phrase, which reaches from its first start to the end of its last string; neighbouring phrases
   overlap, and equal strings lie at the same place relative to equal triggers.
2. Dictionary.  Phrases are counted by trigger.  A trigger met once ends there: none of its strings repeats.  A
   phrase that stands twice or more in the parse is repeated as a whole.
3. Suffix order.  Phrases that share a trigger and are not the same may still share strings.  Each different one is
   taken once; the suffixes at its string starts are sorted bytewise to LENGTH bytes with those of the trigger's
   other phrases, and a suffix equal to a neighbour in that order is repeated.  Suffixes of other triggers can't be
   equal, so the order of each trigger's part is all of the corpus order that is needed.

A trigger with more different phrases than CROWD (a passage that very many texts quote) isn't sorted in one task:
its suffixes are hashed and counted by Spark instead, which gives the same answer.

Defined cases: a null or empty text, and one under LENGTH bytes, loses nothing; rows that share id and text repeat
each other; other columns are kept; an empty table gives an empty result.  Where a text is asked for, a character
that is cut in two goes as a whole.  A very long text is parsed in pieces of PIECE bytes that overlap by a string; of equal
phrases the one of the smallest key and start stands for all, and of equal hashes in a window the first is the trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import as_bytes, chunks, cut_lineage, give_back

LENGTH = 400
#: String starts among whose rolling hashes a trigger is the least: a string holds so many hash windows.  The wider, the
#: fewer phrases; the windows must stay so long that few places share one by chance.
SPREAD = 200
LEAST_GRAM = 41
#: A text longer than this is parsed in overlapping pieces; the strings at a seam fall into two phrases of one trigger.
PIECE = 1 << 18
#: Bytes of phrases that are sorted at once.
SORT_BYTES = 1 << 18
CROWD = 2000
#: Bits of the bitmap that tells which phrases are read again: 16 MB, whatever the number of texts.
SLOTS = 1 << 27

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ALL = np.uint64(2**64 - 1)
_PLACE = np.uint64((1 << 24) - 1)


class _Rolling:
    """Hashes of any substring of a buffer, from running sums modulo 2 ** 64."""

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        if len(data) >= len(_Rolling.powers):
            for name, value in (("powers", _BASE), ("inverse", pow(_BASE, -1, 2**64))):
                x = np.full(len(data) + 1, value, np.uint64)
                x[0] = 1
                setattr(_Rolling, name, np.multiply.accumulate(x))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _Rolling.powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        v = (self.sums[end] - self.sums[start]) * _Rolling.inverse[start]
        for _ in range(2):
            v ^= v >> np.uint64(32)
            v *= _MIX
        return v ^ (v >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of every window."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, _ALL)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def parse_pieces(pieces: list[tuple[int, bytes, int]], length: int, spread: int):
    """Phrases of (key, bytes, offset of the bytes in the text): arrays trigger, phrase, key, first start, starts."""
    data = np.frombuffer(b"".join(p[1] for p in pieces), np.uint8)
    gram = length - spread + 1
    if len(data) < length:
        return None
    sizes = np.array([len(p[1]) for p in pieces])
    begins = np.cumsum(sizes) - sizes
    inside = np.zeros(len(data) + 1, np.int8)
    long = sizes >= length
    inside[begins[long]] += 1
    inside[begins[long] + sizes[long] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[: len(data) - length + 1])
    if not len(starts):
        return None
    rolling = _Rolling(data)
    at = np.arange(len(data) - gram + 1)
    grams = rolling.of(at, at + gram)
    chosen = _least((grams & ~_PLACE) | at.astype(np.uint64), spread)[starts] & _PLACE
    piece = np.searchsorted(begins, starts, side="right") - 1
    fresh = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(piece) != 0)) + 1
    first = np.concatenate(([0], fresh))
    last = np.concatenate((fresh - 1, [len(starts) - 1]))
    lo, hi, owner, trigger = starts[first], starts[last], piece[first], chosen[first].astype(np.int64)
    phrase = rolling.of(lo, hi + length) ^ (rolling.of(lo, trigger) + (hi - lo).astype(np.uint64) * _MIX)
    keys = np.array([p[0] for p in pieces], np.int64)[owner]
    offsets = np.array([p[2] for p in pieces], np.int64)[owner]
    return grams[trigger].view(np.int64), phrase.view(np.int64), keys, (lo - begins[owner] + offsets), (hi - lo + 1)


def _spread(spread: int, length: int) -> int:
    return min(spread, max(length // 2, length - LEAST_GRAM + 1))


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[int, bytes, int]]:
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
            for at in range(0, max(1, len(text) - length + 1), PIECE):
                yield key, text[at : at + PIECE + length - 1], at


def parse(keyed: DataFrame, length: int = LENGTH, spread: int = SPREAD) -> DataFrame:
    """(trigger, phrase, key, start, n): the parse of all texts; a phrase has n strings, from start on."""
    names = ["trigger", "phrase", "key", "start", "n"]
    spread = _spread(spread, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in chunks(_pieces(batches, length)):
            found = parse_pieces(group, length, spread)
            if found is not None:
                yield pa.record_batch([*(pa.array(c, pa.int64()) for c in found[:3]), *(pa.array(c, pa.int64()).cast(pa.int32()) for c in found[3:])], names=names)
        give_back()

    return keyed.select("key", "text").filter(F.octet_length("text") >= length).mapInArrow(run, "trigger long, phrase long, key long, start int, n int")


def repeated_runs(rows: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """(key, start, end) of the repeated bytes of (key, start, bytes), by suffix order to ``length`` bytes."""
    data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    sizes = np.array([len(r[2]) for r in rows])
    begins = np.cumsum(sizes) - sizes
    starts = np.concatenate([np.arange(b, b + n - length + 1) for b, n in zip(begins, sizes, strict=True)])
    suffixes = np.lib.stride_tricks.sliding_window_view(data, length)[starts].view(f"S{length}").ravel()
    order = np.argsort(suffixes)
    ranked = suffixes[order]
    same = ranked[1:] == ranked[:-1]
    repeated = np.zeros(len(starts), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    owner = np.searchsorted(begins, starts, side="right") - 1
    hit = np.flatnonzero(repeated)
    if not len(hit):
        return []
    fresh = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)) + 1
    first, last = hit[np.concatenate(([0], fresh))], hit[np.concatenate((fresh - 1, [len(hit) - 1]))]
    return [(rows[o][0], rows[o][1] + int(s - begins[o]), rows[o][1] + int(e - begins[o]) + length) for o, s, e in zip(owner[first].tolist(), starts[first], starts[last], strict=True)]


def _sorted_groups(length: int):
    """Sorts the suffixes of rows (trigger, key, start, part), which come ordered by trigger."""

    def groups(batches: Iterator[pa.RecordBatch]):
        held, size, last = [], 0, None
        for b in batches:
            for trigger, key, start, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), as_bytes(b.column(3)), strict=True):
                if size > SORT_BYTES and trigger != last:
                    yield held
                    held, size = [], 0
                held.append((key, start, part))
                size, last = size + len(part), trigger
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            runs = list(zip(*repeated_runs(rows, length))) or [[]] * 3
            yield pa.record_batch([pa.array(runs[0], pa.int64()), pa.array(runs[1], pa.int32()), pa.array(runs[2], pa.int32())], names=["key", "s", "e"])
        give_back()

    return run


def _slots(phrases: DataFrame):
    """A bitmap of SLOTS bits, broadcast, in which the slot of each (key, start) is set."""
    slot = F.col("key").bitwiseXOR(F.col("start").cast("long")).bitwiseAND(F.lit(SLOTS - 1))
    # Spark builds bitmaps of 4096 bytes.
    rows = phrases.groupBy(F.shiftright(slot, 15).alias("at")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")).toArrow()
    bits = np.zeros((SLOTS >> 15, 4096), np.uint8)
    for at, held in zip(rows["at"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        bits[at] = np.frombuffer(held, np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(bits.ravel())


def phrase_bytes(keyed: DataFrame, phrases: DataFrame, length: int, spread: int) -> DataFrame:
    """``phrases`` (trigger, key, start and more) with their bytes as ``part``.

    Texts are parsed once more rather than shuffled: a bitmap of fixed size tells which phrases may be meant, a join with
    their bytes which are.  The fuller the bitmap, the more are sent in vain."""
    spread, sent = _spread(spread, length), _slots(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for group in chunks(_pieces(batches, length)):
            found = parse_pieces(group, length, spread)
            if found is None:
                continue
            trigger, _, key, start, n = found
            slot = (key ^ start) & (SLOTS - 1)
            at = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            if not len(at):
                continue
            of = {(k, o): piece for k, piece, o in group}
            parts = []
            for k, s, m in zip(key[at].tolist(), start[at].tolist(), n[at].tolist(), strict=True):
                offset = s // PIECE * PIECE
                parts.append(of[k, offset][s - offset : s - offset + m + length - 1])
            yield pa.record_batch([pa.array(trigger[at]), pa.array(key[at]), pa.array(start[at]).cast(pa.int32()), pa.array(parts, pa.binary())], names=["trigger", "key", "start", "part"])
        give_back()

    found = keyed.select("key", "text").filter(F.octet_length("text") >= length).mapInArrow(run, "trigger long, key long, start int, part binary")
    return phrases.join(found, ["trigger", "key", "start"])


def _hashed_suffixes(length: int):
    """(hash, key, start) of every string of the phrases of crowded triggers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True)
            for group in chunks(rows, at=2):
                hashes, keys, places = [], [], []
                for key, start, part in group:
                    at = np.arange(len(part) - length + 1)
                    hashes.append(_Rolling(np.frombuffer(part, np.uint8)).of(at, at + length))
                    keys.append(np.full(len(at), key))
                    places.append(start + at)
                yield pa.record_batch([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(places), pa.int64()).cast(pa.int32())], names=["hash", "key", "s"])

    return run


def repeated(keyed: DataFrame, length: int = LENGTH, spread: int = SPREAD, crowd: int = CROWD) -> DataFrame:
    """(key, runs): for each row of (key, text) with repeats, the byte ranges that repeated strings cover."""
    phrases = parse(keyed, length, spread)
    triggers = phrases.groupBy("trigger").agg(F.count(F.lit(1)).alias("met"), F.min("phrase").alias("low"), F.max("phrase").alias("high")).filter("met > 1")
    # Written down, so that the join below has a plain shuffle on each side and Spark can split a trigger's many rows.
    triggers = cut_lineage(triggers.select("trigger", (F.col("low") != F.col("high")).alias("mixed")))
    # What is left is a fraction of the parse and is used several times, so it is written down once.
    again = cut_lineage(phrases.join(triggers, "trigger"))
    whole = F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n") + (length - 1)).alias("e"))

    # Triggers with different phrases: those that stand once need the suffix order, the others are witnesses.
    mixed = again.filter("mixed")
    dictionary = cut_lineage(mixed.groupBy("trigger", "phrase").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("key", "start")).alias("one")))
    sizes = cut_lineage(dictionary.groupBy("trigger").agg(F.count(F.lit(1)).alias("different"), F.min("met").alias("least")).filter("least = 1"))
    open_phrases = cut_lineage(dictionary.join(sizes, "trigger").select("trigger", "one.key", "one.start", (F.col("different") > crowd).alias("crowded")))

    parts = cut_lineage(phrase_bytes(keyed, open_phrases, length, spread).select("trigger", "key", "start", "part", "crowded"))
    every = again.filter("not mixed").select("key", whole.alias("r")).select("key", "r.*")
    settled = mixed.join(dictionary.filter("met > 1").select("trigger", "phrase"), ["trigger", "phrase"]).select("key", whole.alias("r")).select("key", "r.*")
    ordered = parts.filter("not crowded").drop("crowded").repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_sorted_groups(length), "key long, s int, e int")
    every = every.unionByName(settled).unionByName(ordered)
    if not open_phrases.filter("crowded").isEmpty():
        hashed = parts.filter("crowded").select("key", "start", "part").mapInArrow(_hashed_suffixes(length), "hash long, key long, s int")
        twice = cut_lineage(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("met")).filter("met > 1").select("hash"))
        every = every.unionByName(hashed.join(twice, "hash").select("key", "s", (F.col("s") + length).alias("e")))
    return cut_lineage(every.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("runs")))


def remove(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD, crowd: int = CROWD, as_text: bool = False) -> DataFrame:
    """All columns of ``docs``, and ``kept`` (binary, or text of its whole characters) and ``spans`` (the maximal
    removed byte ranges)."""
    columns = [f"d{k}" for k in range(len(docs.columns))]
    keyed = docs.toDF(*columns).withColumn("text", F.coalesce(F.col(columns[docs.columns.index("text")]), F.lit("")))
    keyed = keyed.withColumn("key", F.xxhash64(F.coalesce(F.col(columns[docs.columns.index("doc_id")]).cast("long"), F.lit(-(2**62))), F.col("text")))
    joined = keyed.join(repeated(keyed, length, spread, crowd), "key", "left").select(*columns, "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                kept, spans = [], []
                for text, runs in zip(as_bytes(part.column(len(columns))), part.column(len(columns) + 1).to_pylist(), strict=True):
                    merged: list[list[int]] = []
                    for r in sorted((r["s"], r["e"]) for r in runs or []):
                        if merged and r[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], r[1])
                        else:
                            merged.append(list(r))
                    edges = [0, *(x for m in merged for x in m), len(text)]
                    kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"start": s, "end": e} for s, e in merged])
                kept = pa.array([whole_characters(k) for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], kept, pa.array(spans, kind)], names=[*columns, "kept", "spans"])

    kinds = ", ".join(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in columns)
    out = joined.mapInArrow(run, f"{kinds}, kept {'string' if as_text else 'binary'}, spans array<struct<start: bigint, end: bigint>>")
    return out.toDF(*docs.columns, "kept", "spans")


def whole_characters(kept: bytes) -> str:
    """Text of the remaining bytes, without characters that were cut in two."""
    return kept.decode("utf-8", "ignore")


def rewrite(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows and columns of ``docs`` with their texts less the repeats; n_chars, where there is one, follows."""
    # Columns of other names are set aside, so that none clashes with those that are added.
    inner = docs.toDF(*[c if c in ("doc_id", "text", "n_chars") else f"x{k}" for k, c in enumerate(docs.columns)])
    out = remove(inner, length, as_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    changed = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.withColumns(changed).select(*inner.columns).toDF(*docs.columns)
