"""SimHash near-duplicates (operator 4): tiled exact comparison of 64-bit fingerprints.

Each fingerprint is compared with all others that can lie within the radius, by numpy exclusive-or and bit counts
over tiles.  A tile holds different fingerprints with the same population count in each 16-bit quarter; where the
four counts of two tiles differ by more than the radius in sum, no pair of theirs can link, and the tile pair is
skipped: tiles are joined on the count vectors within the radius, half of the directions each.  A tile is bounded
in size; a crowded count vector has several.  A task reduces the links that it finds in a tile pair to a spanning
forest, so a group of near copies never yields all its pairs, and components are joined over those forests.

Defined cases: a very long text is fingerprinted whole; a null or text without words has fingerprint zero and links like any other; equal fingerprints link
(whatever the texts); a text of one to three words is one shingle; rows that share an id are
fingerprinted each; a null id is larger than any other; other columns are ignored; an empty table gives an empty result;
a bit that exactly half of the shingles set is not set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import as_bytes, cut_lineage, row_key, texts

RADIUS = 4
#: Fingerprints of a tile at most.
TILE = 2048
QUARTER = 16
SHINGLE = 4
SEED = 42


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bit i is set where it is set in over half of the XXH64 hashes of the word shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t) for t in as_bytes(b.column(2))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(prints, pa.int64())], names=["doc_id", "key", "fp"])

    return texts(docs).select("doc_id", row_key().alias("key"), "text").mapInArrow(run, "doc_id long, key long, fp long")


def _directions(radius: int) -> list[tuple[int, ...]]:
    """Count vectors' differences within the radius, one of each opposite two; the zero vector first."""
    steps = range(-radius, radius + 1)
    near = [d for d in product(steps, repeat=4) if sum(map(abs, d)) <= radius and d > (0, 0, 0, 0)]
    return [(0, 0, 0, 0), *near]


def _code(*counts):
    """A count vector as one number; the counts plus a difference stay within 0 to 63."""
    a, b, c, d = counts
    return ((a * 64 + b) * 64 + c) * 64 + d


def _forest(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Star links that connect what the links (a[i], b[j]) connect."""
    nodes = np.concatenate((a, b))
    left, right = i, j + len(a)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return list(zip(nodes[own].tolist(), nodes[label[own]].tolist(), strict=True))


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                a = left.values.to_numpy().view(np.uint64)
                b = right.values.to_numpy().view(np.uint64)
                rows, cols = [], []
                step = max(1, (1 << 18) // max(1, len(b)))
                for at in range(0, len(a), step):
                    i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
                    rows.append(i + at)
                    cols.append(j)
                i, j = np.concatenate(rows), np.concatenate(cols)
                apart = a[i] != b[j]
                if apart.any():
                    found += _forest(left.values.to_numpy(), right.values.to_numpy(), i[apart], j[apart])
            pairs = list(zip(*found)) or [[], []]
            yield pa.record_batch([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["u", "v"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): links between different fingerprints (column fp) that connect all within the radius of each other."""
    different = prints.select("fp").distinct()
    quarters = [F.bit_count(F.shiftrightunsigned("fp", QUARTER * k).bitwiseAND(0xFFFF)) + 8 for k in range(4)]
    coded = different.withColumn("cell", _code(*quarters).cast("int"))
    # A cell's size decides into how many tiles its fingerprints are dealt; there are 17 ** 4 cells at most.
    sizes = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    dealt = coded.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / (tile * 3 / 4))).cast("int"))
    tiles = dealt.groupBy("cell", "part").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    ways = F.array(*[F.lit(_code(*d)) for d in _directions(radius)])
    near = tiles.select(F.col("fps").alias("a"), "cell", F.col("part").alias("own"), F.explode(ways).alias("way")).select("a", F.col("cell").alias("from"), "own", (F.col("cell") + F.col("way")).alias("cell"))
    pairs = near.join(tiles, "cell").filter((F.col("cell") != F.col("from")) | (F.col("own") <= F.col("part")))
    return pairs.select("a", F.col("fps").alias("b")).mapInArrow(_compare(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the links (u, v) with the smallest node that it is connected with.

    Large-star and small-star steps in turn, until every node hangs on one node that hangs on none.  Each step asks for
    the least lesser neighbour of nodes; these are written down first, so both joins have a plain shuffle on each side
    and Spark splits the many links of a hub.  State is cut by a reliable checkpoint in every step.
    """
    edges = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        low = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        # Settled: every node has one lesser neighbour, and none of these has one itself.
        if low.filter("n > 1").isEmpty() and edges.join(low.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = edges.join(low.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = cut_lineage(large.distinct())
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(hung.union(low.select("u", F.col("m").alias("v"))).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, key, fp, root (the smallest fingerprint of the component) and component_id (the smallest doc_id
    reachable by links within the radius) of every row."""
    prints = cut_lineage(fingerprints(docs))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(prints, radius))
    classes = cut_lineage(first.join(roots, first.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id"))
    # Written down for a plain shuffle on each side of the join: a root may have a third of all fingerprints.
    smallest = cut_lineage(classes.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = cut_lineage(classes.join(smallest, "root").select("fp", "root", "component_id"))
    return prints.join(named, "fp").select("doc_id", "key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component of near duplicates, the one with the smallest doc_id, with its columns.  Of rows that
    share id and text one stays whole, the one whose columns hash least."""
    columns = [f"d{k}" for k in range(len(docs.columns))]
    inner = docs.toDF(*columns)
    named = {c: columns[docs.columns.index(c)] for c in ("doc_id", "text")}
    found = near_duplicates(inner.select(*[F.col(own).alias(c) for c, own in named.items()]), radius)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")).select("first.key")
    keyed = inner.withColumns({"doc_id": F.col(named["doc_id"]).cast("long"), "text": F.coalesce(F.col(named["text"]), F.lit(""))}).withColumn("key", row_key())
    same = keyed.join(kept, "key", "left_semi")
    hashed = F.xxhash64(F.to_json(F.struct(*columns)))
    once = same.groupBy("key").agg(F.min_by(F.struct(*columns), hashed).alias("row"))
    return once.select("row.*").toDF(*docs.columns)


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
