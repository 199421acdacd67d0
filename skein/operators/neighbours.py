"""Approximate nearest neighbours of many queries: lists around centroids, and signatures of random hyperplanes.

Every row is in the list of its nearest centroid and carries a signature, one bit for each of PLANES random hyperplanes.  Two
vectors at an angle a differ in a share a / pi of the bits, give or take the deviation of a binomial.  A search has two
rounds.  The first compares a query with the rows of its nearest lists and finds its k best so far, and with them an angle
beyond which nothing is wanted.  The second goes through the other lists that are probed, reads the signatures there and
compares only the rows whose bits differ by no more than that angle allows and ``slack`` deviations on top: a neighbour
within the angle is passed over with the small probability that ``slack`` states, whatever the number of rows.

Lists follow the rows (the square root of their number) and are dealt in blocks, so a large one is spread; blocks of
queries meet the blocks of the lists they probe only, and no pair of single vectors is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.store import settled
from skein.operators.vectors import QUERIES, ROWS, batch_topk, best_of, centroids, matrix

#: Bits of a signature.
PLANES = 512
#: Lists whose rows are all compared, and deviations that a neighbour's signature may be off.
FIRST, SLACK = 2, 0.5

FOUND = "query_id long, id long, score double, compared long"


def signatures(unit: np.ndarray, seed: int = 11) -> np.ndarray:
    """Bits of unit vectors, 64 to a number."""
    planes = np.random.default_rng(seed).standard_normal((unit.shape[1], PLANES))
    return np.packbits(unit @ planes > 0, axis=1).view(np.uint64)


def indexed(df: DataFrame, id_: str, vector: str, sent, lists: int) -> DataFrame:
    """(id, v, signature, list, turn): a row for each of the ``lists`` lists nearest to a vector, the nearest at turn 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(sent.value):
                unit = matrix(b.column(1))
                near = np.argsort(-(unit @ sent.value.T), axis=1, kind="stable")[:, :lists]
                bits = pa.array([s.tobytes() for s in signatures(unit)], pa.binary())
                at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), bits.take(at), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(near.shape[1], dtype=np.int32), b.num_rows))], names=["id", "v", "signature", "list", "turn"])

    return df.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(run, "id long, v array<float>, signature binary, list int, turn int")


def _compare(k: int, slack: float):
    """Blocks of rows against blocks of queries: the k best, and how many rows each query was compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, asked = b.column(0)[i].values, b.column(1)[i].values
                ids, qids = (x.field("id").to_numpy(zero_copy_only=False) for x in (rows, asked))
                scores = np.round(matrix(asked.field("v")) @ matrix(rows.field("v")).T, 9)
                allowed, bound = None, asked.field("bound").to_numpy(zero_copy_only=False).astype(float)
                if np.isfinite(bound).any():
                    bits = lambda x: np.frombuffer(b"".join(x.field("signature").to_pylist()), np.uint64).reshape(len(x), -1)
                    far, near = bits(asked), bits(rows)
                    differ = sum(np.bitwise_count(far[:, None, w] ^ near[None, :, w]).astype(np.int16) for w in range(far.shape[1]))
                    share = np.arccos(np.clip(bound, -1, 1)) / np.pi
                    allowed = (differ <= (PLANES * share + slack * np.sqrt(PLANES * share * (1 - share)))[:, None]) | ~np.isfinite(bound)[:, None]
                q, r = best_of(scores, ids, allowed, k)
                n = np.full(len(qids), len(ids)) if allowed is None else allowed.sum(axis=1)
                # What a query was compared with is told once for each block, on a row without an id.
                yield pa.record_batch([pa.array(np.concatenate((qids[q], qids))), pa.array([*ids[r].tolist(), *[None] * len(qids)], pa.int64()), pa.array([*scores[q, r].tolist(), *[None] * len(qids)], pa.float64()), pa.array(np.concatenate((np.zeros(len(q), np.int64), n)))], names=["query_id", "id", "score", "compared"])

    return run


def _met(rows: DataFrame, asked: DataFrame, sizes: DataFrame, k: int, slack: float) -> DataFrame:
    """FOUND rows of all queries (id, v, signature, list, bound) against the rows of their lists.  ``sizes`` has the number
    of blocks of each list."""
    dealt = rows.join(sizes, "list").withColumn("r", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    row_blocks = dealt.groupBy("list", "r").agg(F.collect_list(F.struct("id", "v", "signature")).alias("rows"))
    counted = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(1 + asked_blocks(asked))).cast("int"))
    query_blocks = counted.groupBy("list", "q").agg(F.collect_list(F.struct("id", "v", "signature", "bound")).alias("asked"))
    sent = query_blocks.join(sizes, "list").select("list", "asked", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("r"))
    return row_blocks.join(sent, ["list", "r"]).select("rows", "asked").mapInArrow(_compare(k, slack), FOUND)


def asked_blocks(asked: DataFrame) -> int:
    """Blocks beyond the first that the queries of the most asked list need."""
    most = asked.groupBy("list").count().agg(F.max("count")).first()[0] or 0
    return int(most) // QUERIES


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.filter("id IS NOT NULL").withColumn("rank", place).filter(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, probes: float = 0.85, lists: int | None = None, first: int = FIRST, slack: float = SLACK, counts: bool = False) -> DataFrame:
    """(query_id, id, score, rank): about the k nearest by cosine, among the rows of a share ``probes`` of the lists.

    With ``counts`` (query_id, compared): how many rows each query was compared with."""
    n = lists or max(1, isqrt(rows.count()))
    fitted_on = centroids(rows, id_, vector, n)
    sent = rows.sparkSession.sparkContext.broadcast(fitted_on)
    # Written down: finding the nearest lists is most of the work, and both rounds need them.
    held = settled(indexed(rows, id_, vector, sent, 1).drop("turn"))
    asked = settled(indexed(queries, id_, vector, sent, max(first, round(probes * len(fitted_on)))))
    sizes = held.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("blocks"))
    near = _met(held, asked.filter(F.col("turn") < first).withColumn("bound", F.lit(None).cast("double")), sizes, k, slack)
    # Written down, as the second round needs the first for its bounds and again for its result.
    near = near.sparkSession.createDataFrame([], FOUND) if not len(fitted_on) else settled(near)
    bound = _top(near, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bound"))
    far = asked.filter(F.col("turn") >= first).join(bound, F.col("id") == F.col("query_id"), "left").drop("query_id")
    both = near.unionByName(_met(held, far, sizes, k, slack))
    if counts:
        return both.groupBy("query_id").agg(F.sum("compared").alias("compared"))
    return _top(both, k).select("query_id", "id", "score", "rank")


def within(rows: DataFrame, queries: DataFrame, id_: str, vector: str, key: str, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of each query among the rows of its own key, exact.  A key's rows are
    dealt in blocks like a list's; a row or query without a key meets none."""
    side = lambda df: df.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), F.lit(b"").alias("signature"), F.col(key).alias("list"))
    sizes = rows.groupBy(F.col(key).alias("list")).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("blocks"))
    return _top(_met(side(rows), side(queries).withColumn("bound", F.lit(None).cast("double")), sizes, k, 0.0), k).select("query_id", "id", "score", "rank")


def measured(rows: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, **how) -> DataFrame:
    """One row: queries, rows, recall against the exact search, and the mean share of all rows that were compared."""
    exact = batch_topk(rows, queries, id_, vector, k).select("query_id", "id")
    hit = search(rows, queries, id_, vector, k, **how).select("query_id", "id", F.lit(1).alias("hit"))
    recall = exact.join(hit, ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    spent = search(rows, queries, id_, vector, k, counts=True, **how).agg(F.count(F.lit(1)).alias("queries"), F.avg("compared").alias("mean"))
    size = rows.agg(F.count(F.lit(1)).alias("rows"))
    return spent.crossJoin(size).crossJoin(recall).select("queries", "rows", F.round("recall", 4).alias("recall"), F.round(F.col("mean") / F.col("rows"), 4).alias("compared_share"))
