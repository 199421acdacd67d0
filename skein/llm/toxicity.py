"""Toxicity (operator 7): a factorization machine over hashed terms.

The score of a text is the logistic of a bias, a weight for each of its terms, and the products of its terms' factor
vectors for each pair of them; so two terms, such as an insult and a mention of a group, can say together what
neither says alone.  Terms are words without outer punctuation, A-Z folded, hashed.  It is fitted on a bounded sample
of labelled documents.  Terms get a weight and a factor vector in three ways: by a difference between the labels alone,
by one among the documents with a term of the first kind, or as one of two of the PAIRED most frequent terms whose
meeting differs between the labels beyond what both do alone, as in an exclusive-or, whatever each says alone.  Others
have none, as fitting all terms of a sample learns it by heart.

Defined cases: a null or empty text has no terms and the bias for a score; without training labels of both kinds every
score is 0; repeated rows score alike; terms that tie in frequency are taken by bucket; a very long text is counted
whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import as_bytes, fold, texts
from skein.llm.labelled import training_sample

FOLDS, HELD_OUT = 3, 1
#: Labelled documents that the machine is fitted on at most.
SAMPLE = 12_000
BUCKETS = 1 << 18
FACTORS = 6
#: Passes over the sample, and gradient steps at least, of so many documents each.
EPOCHS = 15
STEPS = 1500
BATCH = 256
#: Weight of toxic documents against others: as a part of what balances them.
BALANCE = 1.0
RATE = 0.08
DECAY = 2e-4
#: A term needs so many documents of the sample, and such a difference between labels in standard deviations.
LEAST_DOCS = 4
LEAST_Z = 3.5
#: The same among the documents with a term that differs alone; more, as there are as many tests as pairs.
LEAST_PAIR_Z = 5.0
#: So many terms, the most frequent in the sample, are tested for all their pairs: a pair needs so many documents, and
#: such a difference.  Counts are products of blocks of 0-1 rows, so memory is PAIRED ** 2 whatever the sample.
PAIRED = 1536
LEAST_MET = 12
LEAST_MET_Z = 6.0
REJECT = 0.7

_OUTER = b".,;:!?\"'()[]{}<>*_-#%$&|"


def terms(text: bytes) -> dict[int, int]:
    """Bucket to frequency."""
    found: dict[int, int] = {}
    for word, n in Counter(text.lower().split()).items():
        k = zlib.crc32(word.strip(_OUTER)) % BUCKETS
        found[k] = found.get(k, 0) + n
    return found


def _z(held, toxic, p: float, n: int):
    """By how many standard deviations the toxic of the documents that hold a term differ from the share p of n."""
    return np.abs(toxic - held * p) / np.sqrt(held * p * (1 - p) * (1 - held / (n + 1)) + 1e-9)


def _told_by_pairs(counted: list[dict[int, int]], y: np.ndarray, anchors: list[int]) -> set[int]:
    """Terms that differ between the labels among the documents with one of the anchors."""
    every, place = np.unique(np.array([b for row in counted for b in row], np.int64), return_inverse=True)
    sizes = np.array([len(row) for row in counted])
    rows = np.split(place, np.cumsum(sizes)[:-1])
    docs_of: dict[int, list[int]] = {a: [] for a in anchors}
    for i, row in enumerate(counted):
        for a in row.keys() & docs_of.keys():
            docs_of[a].append(i)
    found = np.zeros(len(every), bool)
    for docs in docs_of.values():
        p = y[docs].mean()
        terms_of = np.concatenate([rows[i] for i in docs])
        held = np.bincount(terms_of, minlength=len(every))
        toxic = np.bincount(terms_of, np.repeat(y[docs], sizes[docs]), len(every))
        found |= (held >= LEAST_DOCS) & (_z(held, toxic, p, len(docs)) >= LEAST_PAIR_Z)
    return set(every[found].tolist())


def _told_by_meeting(counted: list[dict[int, int]], y: np.ndarray, paired: int = PAIRED) -> set[int]:
    """Terms of pairs whose documents differ in labels from what each term's documents have alone."""
    with_term = Counter(b for row in counted for b in row)
    own = sorted((b for b, n in with_term.items() if n >= LEAST_MET), key=lambda b: (-with_term[b], b))[:paired]
    place = {b: k for k, b in enumerate(own)}
    met, toxic_met = np.zeros((len(own), len(own)), np.float32), np.zeros((len(own), len(own)), np.float32)
    for at in range(0, len(counted), 1000):
        x = np.zeros((len(counted[at : at + 1000]), len(own)), np.float32)
        for i, row in enumerate(counted[at : at + 1000]):
            x[i, [place[b] for b in row.keys() & place.keys()]] = 1
        met += x.T @ x
        some = x[y[at : at + 1000] == 1]
        toxic_met += some.T @ some
    share = np.diag(toxic_met) / np.maximum(np.diag(met), 1)
    # Expected from the terms alone: their odds against all documents' odds, multiplied.
    odds = np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3))
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    found = np.zeros(len(own), bool)
    for i in range(len(own)):
        both = odds[i] * odds / (p / (1 - p))
        want = both / (1 + both)
        z = np.abs(toxic_met[i] - met[i] * want) / np.sqrt(met[i] * np.maximum(want * (1 - want), 0.01) + 1e-9)
        hit = (met[i] >= LEAST_MET) & (z >= LEAST_MET_Z)
        hit[i] = False
        found |= hit
        found[i] |= hit.any()
    return {own[k] for k in np.flatnonzero(found)}


class FactorizationMachine:
    """Weights of the chosen buckets; the number of these is bounded by BUCKETS."""

    def __init__(self, factors: int = FACTORS) -> None:
        self.place: dict[int, int] = {}
        self.bias, self.linear, self.pairs = 0.0, np.zeros(0), np.zeros((0, factors))
        self.trained = False

    def _rows(self, counted: list[dict[int, int]]):
        """Rows as flat arrays: row, place, value."""
        row, place, value = [], [], []
        for i, terms_of in enumerate(counted):
            for bucket in sorted(terms_of.keys() & self.place.keys()):
                row.append(i)
                place.append(self.place[bucket])
                value.append(1 + np.log(terms_of[bucket]))
        return np.array(row, np.int64), np.array(place, np.int64), np.array(value, np.float64)

    def _margin(self, n: int, row, place, value):
        s = np.zeros((n, self.pairs.shape[1]))
        vx = self.pairs[place] * value[:, None]
        np.add.at(s, row, vx)
        own = np.bincount(row, (vx * vx).sum(axis=1), n)
        return self.bias + np.bincount(row, self.linear[place] * value, n) + 0.5 * ((s * s).sum(axis=1) - own), s, vx

    def fit(self, counted: list[dict[int, int]], labels: list[int]) -> FactorizationMachine:
        y = np.array(labels, np.float64)
        if not len(y) or y.min() == y.max():
            return self
        with_term, toxic_with = Counter(), Counter()
        for row, label in zip(counted, labels, strict=True):
            with_term.update(row.keys())
            if label:
                toxic_with.update(row.keys())
        p, n = y.mean(), len(y)
        chosen = [b for b, c in with_term.items() if c >= LEAST_DOCS and _z(c, toxic_with[b], p, n) >= LEAST_Z]
        chosen = {*chosen, *_told_by_pairs(counted, y, chosen), *_told_by_meeting(counted, y)}
        self.place = {b: i for i, b in enumerate(sorted(chosen))}
        rng = np.random.default_rng(3)
        self.linear = np.zeros(len(chosen))
        self.pairs = rng.normal(0, 0.02, (len(chosen), self.pairs.shape[1]))
        self.bias = float(np.log(p / (1 - p)))
        seen = [1e-2, np.full(len(chosen), 1e-2), np.full(self.pairs.shape, 1e-2)]
        row, place, value = self._rows(counted)
        sizes = np.bincount(row, minlength=n)
        places, values = (np.split(x, np.cumsum(sizes)[:-1]) for x in (place, value))
        weight = np.where(y == 1, max(1.0, BALANCE * (1 - p) / p), 1.0)
        order = np.arange(n)
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // n))):
            rng.shuffle(order)
            for at in range(0, n, BATCH):
                some = order[at : at + BATCH]
                place, value = (np.concatenate([x[i] for i in some]) for x in (places, values))
                row = np.repeat(np.arange(len(some)), sizes[some])
                margin, s, vx = self._margin(len(some), row, place, value)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[some]) * weight[some] / len(some)
                steps = [error.sum(), np.bincount(place, error[row] * value, len(chosen)) + DECAY * self.linear, DECAY * self.pairs]
                np.add.at(steps[2], place, error[row][:, None] * value[:, None] * (s[row] - vx))
                seen = [a + g * g for a, g in zip(seen, steps, strict=True)]
                self.bias -= RATE * steps[0] / np.sqrt(seen[0])
                self.linear -= RATE * steps[1] / np.sqrt(seen[1])
                self.pairs -= RATE * steps[2] / np.sqrt(seen[2])
        self.trained = True
        return self

    def score(self, counted: list[dict[int, int]]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(counted))
        margin, _, _ = self._margin(len(counted), *self._rows(counted))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Term counts of the bounded sample come to the driver; texts don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = [terms(t) for t in as_bytes(b.column(1))]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([list(c.keys()) for c in counted], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))], names=["doc_id", "label", "buckets", "counts"])

    rows = training_sample(docs, labels, "toxic", FOLDS, HELD_OUT, sample).mapInArrow(run, "doc_id long, label int, buckets array<int>, counts array<int>").toArrow().sort_by("doc_id")
    counted = [dict(zip(b, c)) for b, c in zip(rows["buckets"].to_pylist(), rows["counts"].to_pylist(), strict=True)]
    return FactorizationMachine().fit(counted, rows["label"].to_pylist())


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.record_batch([part.column(0), pa.array(sent.value.score([terms(t) for t in as_bytes(part.column(1))]), pa.float64())], names=["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
