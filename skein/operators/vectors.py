"""Vector operators: similarities as Columns, exact top-k of many queries in blocks, and centroids (the approximate search is in skein.operators.neighbours)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block of vectors, and of one block of queries.
ROWS, QUERIES = 4096, 512
#: Rows that an encoder gives on at once.
PART = 1024
#: Vectors that centroids are fitted on at most, those of least hash of id; rounds of fitting.
SAMPLE, ROUNDS = 10_000, 15


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def negative_l2(a: Column, b: Column) -> Column:
    return -F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalised(a: Column) -> Column:
    return F.when(norm(a) == 0, _double(a)).otherwise(F.transform(_double(a), lambda x: x / norm(a)))


def fitted(a: Column, dim: int) -> Column:
    """Cut, or padded with zeros, to a dimension."""
    return F.slice(F.concat(_double(a), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def topk(df: DataFrame, vector: str, query: list[float], k: int, id_: str) -> DataFrame:
    """The k nearest by cosine to one query; ties go to the smaller id."""
    score = F.round(cosine(F.col(vector), F.array(*map(F.lit, query))), 9)
    return df.withColumn("score", score).orderBy(F.desc("score"), id_).limit(k)


def _blocks(df: DataFrame, id_: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows of lists, each of about ``size`` vectors."""
    n = df.count()
    parts = max(1, -(-n // size))
    dealt = df.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).withColumn(name, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return dealt.groupBy(name).agg(F.collect_list(F.struct("id", "v")).alias(f"{name}_rows")), parts


def best_of(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best scores of each row; ties go to the smaller id."""
    held = scores if allowed is None else np.where(allowed, scores, -np.inf)
    n = held.shape[1]
    least = np.partition(held, n - k, axis=1)[:, n - k] if n > k else np.full(len(held), -np.inf)
    row, col = np.nonzero((held >= least[:, None]) & np.isfinite(held))
    order = np.lexsort((ids[col], -held[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[place < k], col[place < k]


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, asked = b.column(0)[i].values, b.column(1)[i].values
                ids, qids = (x.field("id").to_numpy(zero_copy_only=False) for x in (rows, asked))
                scores = np.round(matrix(asked.field("v")) @ matrix(rows.field("v")).T, 9)
                q, r = best_of(scores, ids, None, k)
                yield pa.record_batch([pa.array(qids[q]), pa.array(ids[r]), pa.array(scores[q, r])], names=["query_id", "id", "score"])

    return run


def batch_topk(rows: DataFrame, queries: DataFrame, id_: str, vector: str, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows of each query by cosine, exact.

    Blocks of rows meet blocks of queries, each pair keeps k rows of each query, and these are merged; nothing is
    collected and no pair of single rows is ever a row of a join.
    """
    row_blocks, n = _blocks(rows, id_, vector, ROWS, "r")
    query_blocks, _ = _blocks(queries, id_, vector, QUERIES, "q")
    sent = query_blocks.select("q_rows", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("r"))
    found = row_blocks.join(sent, "r").select("r_rows", "q_rows").mapInArrow(_best(k), "query_id long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Unit vectors, one a row."""
    return _unit(np.array(vectors.flatten(), np.float64).reshape(len(vectors), -1))


def centroids(rows: DataFrame, id_: str, vector: str, lists: int, seed: int = 5) -> np.ndarray:
    """Unit centroids by spherical k-means over a sample of at most SAMPLE rows; fewer if the sample is smaller."""
    sample = rows.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return np.zeros((0, 0))
    u = matrix(sample["v"].combine_chunks())
    c = u[np.random.default_rng(seed).choice(len(u), min(lists, len(u)), replace=False)]
    for _ in range(ROUNDS):
        near = (u @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, u)
        c = np.where(np.bincount(near, minlength=len(c))[:, None] > 0, _unit(sums), c)
    return c


def hash_embedding(text: Column, position: Column, dim: int = 768) -> Column:
    """Four numbers in [-1, 1] from the md5 of text and position, then zeros."""
    digest = F.md5(F.concat(text, F.lit("_"), position.cast("string")))
    part = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("double") / 4294967295.0 * 2 - 1
    return F.concat(F.array(*map(part, range(4))), F.array_repeat(F.lit(0.0), dim - 4))


def hyperplane_bucket(v: Column, dim: int, planes: int, seed: int = 5) -> Column:
    """Bucket number by the signs of products with random directions."""
    rng = np.random.default_rng(seed)
    bits = [F.when(dot(v, F.array(*[F.lit(float(x)) for x in rng.standard_normal(dim)])) > 0, 1 << k).otherwise(0) for k in range(planes)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


def parent_boost(rows: DataFrame, score: str, parent: str) -> DataFrame:
    """Rows with their score raised by a tenth of the best of their parent's, to 1 at most.  The best are aggregated and
    joined, so a parent with very many rows is never one group."""
    best = rows.groupBy(F.col(parent).alias("_parent")).agg(F.max(score).alias("_best"))
    joined = rows.join(best, F.col(parent).eqNullSafe(F.col("_parent")))
    return joined.withColumn(score, F.when(F.col(score).isNotNull(), F.least(F.lit(1.0), F.col(score) + 0.1 * F.col("_best")))).drop("_parent", "_best")


def embedded(df: DataFrame, key: str, text: str, load, size: int = 32) -> DataFrame:
    """(key, embedding) of every row.  ``load()`` is called once a task and returns a function from a list of texts to rows
    of numbers (a model's encoder, for one); it is called with at most ``size`` different texts at a time, blanks collapsed,
    and equal texts of an Arrow batch are embedded once.  A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = load()
        for b in batches:
            told = b.column(1).dictionary_encode()
            made = []
            for at in range(0, len(told.dictionary), size):
                made.append(np.asarray(embed(told.dictionary.slice(at, size).to_pylist()), np.float64))
            rows = np.concatenate(made) if made else np.zeros((0, 0))
            # Only a part of a batch is told as texts or given as rows at once.
            for at in range(0, b.num_rows, PART):
                own = rows[told.indices.slice(at, PART).to_numpy()]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * rows.shape[1], pa.int32()), pa.array(own.ravel()))
                yield pa.record_batch([b.column(0).slice(at, PART), lists], names=["key", "embedding"])

    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    return df.select(F.col(key).cast("long").alias("key"), plain.alias("text")).mapInArrow(run, "key long, embedding array<double>").withColumnRenamed("key", key)


def hash_embedder(dim: int = 4):
    """The embedding of :func:`hash_embedding` for :func:`embedded`."""
    import hashlib

    def embed(texts: list[str]) -> np.ndarray:
        digests = np.frombuffer(b"".join(hashlib.md5(f"{t}_0".encode()).digest() for t in texts), ">u4").reshape(len(texts), 4)
        return np.pad(digests / 4294967295.0 * 2 - 1, ((0, 0), (0, dim - 4)))

    return embed
