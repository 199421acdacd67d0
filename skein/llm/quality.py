"""Quality classifier (operator 3): nearest-neighbour voting among latent-semantic vectors.

Hashed terms of a text (its words, the shapes of its words, and how repetitive it is) are weighted by frequency and
projected by a truncated singular value decomposition.  The decomposition is fitted on a bounded sample of labelled
documents, whose vectors are broadcast.  For every document the cosine products with all of them are computed exactly,
in blocks; the labels of the nearest vote, weighted by similarity, and all that tie with the last of them vote too.

Defined cases: a null or empty text has the terms of an empty text and a score like any other; without any training
label every score is 0.5; repeated rows score alike; other columns are ignored; an empty table gives an empty result; a
very long text is counted whole, in a batch that it fills; neighbours that tie with the last one vote too.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import add_from_text, as_bytes, fold, texts
from skein.llm.labelled import SAMPLE, training_sample

FOLDS, HELD_OUT = 4, 2
#: Hash buckets of words, then of word shapes and of what is said of the whole text.
WORDS, SHAPES = 3072, 1024
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 6
ACCEPT = 0.7
#: A pipeline drops what scores under this: less than ACCEPT, so that doubt keeps a document.
KEEP = 0.5
#: Weight of shapes against words.
SHAPE_WEIGHT = 2.0

_KIND = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def terms(text: bytes, shapes: dict[bytes, int]) -> dict[int, int]:
    """Bucket to frequency.  shapes: a memo of this worker."""
    words = text.split()
    found: dict[int, int] = {}
    for word, n in Counter(words).items():
        k = zlib.crc32(word) % WORDS
        found[k] = found.get(k, 0) + n
        kind = word.translate(_KIND)
        k = shapes.get(kind)
        if k is None:
            if len(shapes) > 100_000:
                shapes.clear()
            k = shapes[kind] = WORDS + zlib.crc32(_RUN.sub(rb"\1", kind)) % SHAPES
        found[k] = found.get(k, 0) + n
    lines = [x for x in text.split(b"\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:]))
    n = max(1, len(words))
    said = [b"lines %d" % (10 * len(set(lines)) // max(1, len(lines))), b"grams %d" % (10 * len(set(grams)) // max(1, len(grams))), b"long %d" % min(14, len(words).bit_length()), b"mean %d" % (min(24, sum(map(len, words)) // n))]
    for s in said:
        found[WORDS + zlib.crc32(s) % SHAPES] = n
    return found


def matrix(rows: list[dict[int, int]]) -> np.ndarray:
    """Log frequencies, rows scaled to length 1 for words and for shapes."""
    x = np.zeros((len(rows), WORDS + SHAPES), np.float32)
    for i, row in enumerate(rows):
        x[i, list(row.keys())] = list(row.values())
    np.log1p(x, out=x)
    x[:, :WORDS] /= np.maximum(np.linalg.norm(x[:, :WORDS], axis=1, keepdims=True), 1e-6)
    x[:, WORDS:] *= SHAPE_WEIGHT / np.maximum(np.linalg.norm(x[:, WORDS:], axis=1, keepdims=True), 1e-6)
    return x


class Neighbours:
    """Projection, and the labelled vectors: at most SAMPLE times RANK numbers, whatever the corpus."""

    def __init__(self, rows: list[dict[int, int]], labels: list[int], rank: int = RANK) -> None:
        self.labels = np.array(labels, np.float32)
        if not rows:
            return
        x = matrix(rows)
        self.centre = x.mean(axis=0)
        x -= self.centre
        rank = min(rank, *x.shape)
        rng = np.random.default_rng(7)
        basis = np.linalg.qr(x @ (x.T @ (x @ rng.standard_normal((x.shape[1], min(rank + 16, len(x)))).astype(np.float32))))[0]
        for _ in range(3):
            basis = np.linalg.qr(x @ (x.T @ basis))[0]
        _, sizes, right = np.linalg.svd(basis.T @ x, full_matrices=False)
        # Equal weight for the latent directions beyond a part of the first keeps small but telling ones in view.
        self.project = (right[:rank] / np.maximum(np.sqrt(sizes[:rank, None]), 1e-3)).T.astype(np.float32)
        self.vectors = self._unit(x @ self.project)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, rows: list[dict[int, int]], k: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        near = np.round(self._unit((matrix(rows) - self.centre) @ self.project) @ self.vectors.T, 5)
        k = min(k, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        weight = np.where(near >= last[:, None], np.maximum(near, 1e-3) ** SHARPNESS, 0).astype(np.float64)
        return np.clip((weight @ self.labels) / weight.sum(axis=1), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Neighbours:
    """Term counts of the bounded sample come to the driver; texts don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[bytes, int] = {}
        for b in batches:
            counted = [terms(t, shapes) for t in as_bytes(b.column(1))]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([list(c.keys()) for c in counted], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))], names=["doc_id", "label", "buckets", "counts"])

    rows = training_sample(docs, labels, "quality", FOLDS, HELD_OUT, sample).mapInArrow(run, "doc_id long, label int, buckets array<int>, counts array<int>").toArrow().sort_by("doc_id")
    counted = [dict(zip(b, c)) for b, c in zip(rows["buckets"].to_pylist(), rows["counts"].to_pylist(), strict=True)]
    return Neighbours(counted, rows["label"].to_pylist())


def score(docs: DataFrame, model: Neighbours, name: str = "score") -> DataFrame:
    """The rows of ``docs`` with the score of their whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        shapes: dict[bytes, int] = {}
        return lambda texts: sent.value.score([terms(t, shapes) for t in texts])

    return add_from_text(docs, name, "double", pa.float64(), make)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose score is not under ``least``, with their columns."""
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return score(docs, fit(docs, labels, sample), name).filter(F.col(name) >= least).drop(name)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score(texts(docs), fit(docs, labels, sample))
    return scored.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
