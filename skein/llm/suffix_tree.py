"""Language-model scores (operator 5): a probabilistic suffix tree.

Tokens are the words of a text, A-Z folded, then one end.  The base is a smoothed unigram model over all training
tokens.  The tree predicts symbols: the most frequent words stand for themselves and the others for a class by their
last bytes, so its alphabet is bounded whatever the corpus.  A context of up to DEPTH symbols becomes a state if it
covers a share SHARE of the training tokens and a likelihood-ratio test finds what follows it to differ from what
follows its longest proper suffix; states' distributions are smoothed with those of that suffix, down to the root,
which is the unigram model.  Each token is predicted by the state that is the longest suffix of what precedes it.  A
word within a class is predicted by states over whole words, whose number grows with the corpus and which stay spread
over tasks (``word_states``), down to the unigram model, so

    score = base_score + sum over tokens of log10(P(symbol | state) / P(symbol | root))
                       + sum over words of classes of log10(P(word | class, state) / P(word | class, root)).

Word counts cover all training documents and stay distributed.  Tasks get those of the most frequent words, at most
KNOWN of them; all other words' counts are joined.  Words are told apart by 64-bit hashes.

Defined cases: a null or empty text is one end; words never trained on count c = 0; without training documents N and V
are 0 and every token has probability 1; repeated rows score alike; other columns are ignored; an empty table gives an
empty result; words of one count are taken in order of their hashes where a place among the symbols is the last, and none
of that count where it is the last among those that are broadcast; a very long text is scored whole, token by token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import BLANK, as_bytes, chunks, cut_lineage, fold, row_key
from skein.llm.word_states import UNKNOWN, unpacked, word_gains

FOLDS, HELD_OUT = 10, 0
ADD = 0.1
KNOWN = 500_000
SYMBOL_WORDS = 512
CLASSES = 64
DEPTH = 3
SHARE = 1e-3
PRIOR = 200.0
#: Different words that a task remembers.
MEMO = 400_000
SEED = 42


def _class_of(word: bytes) -> int:
    return SYMBOL_WORDS + zlib.crc32(word[-3:]) % CLASSES


END, BEGIN = SYMBOL_WORDS + CLASSES, SYMBOL_WORDS + CLASSES + 1
SYMBOLS = BEGIN + 1


@dataclass
class Unigrams:
    """Totals, and the counts of the most frequent words, ordered by hash; symbol is -1 unless the word is one.
    ``within`` is a word's share of the listed words of its class."""

    total: int
    different: int
    ends: int
    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    masses: np.ndarray
    within: np.ndarray

    def log10(self, counts):
        if not self.total:
            return np.zeros(np.shape(counts))
        return np.log10((np.asarray(counts, np.float64) + ADD) / (self.total + ADD * (self.different + 1)))


def count_words(docs: DataFrame) -> DataFrame:
    """(h, class, c): the count of every word in the training documents."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.filter(fold(FOLDS) != HELD_OUT).select(F.explode(F.split(low, f"{BLANK}+")).alias("w")).filter("w <> ''")
    ending = F.expr("substring(encode(w, 'UTF-8'), -3, 3)")
    # Words under three bytes have no third last byte: the expression then starts at the first.
    ending = F.when(F.octet_length("w") <= 3, F.encode("w", "UTF-8")).otherwise(ending)
    return words.groupBy(F.xxhash64("w").alias("h")).agg(F.first((F.crc32(ending) % CLASSES).cast("int")).alias("class"), F.count(F.lit(1)).alias("c"))


def unigrams(counts: DataFrame, ends: int) -> Unigrams:
    """The bounded part of the counts that tasks get."""
    by_class = counts.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toArrow().to_pylist()
    total, different = sum(r["c"] for r in by_class) + ends, sum(r["n"] for r in by_class) + (ends > 0)
    # How many words have each count tells from which count on there are at most KNOWN words.
    steps = counts.groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).toArrow().to_pylist()
    held, least = 0, None
    for r in steps:
        if held + r["n"] > KNOWN:
            break
        held, least = held + r["n"], r["c"]
    top = counts.filter(F.col("c") >= least if least is not None else F.lit(False)).select("h", "class", "c").toArrow()
    hashes, classes, c = (top[k].to_numpy() for k in ("h", "class", "c"))
    order = np.lexsort((hashes, -c))
    symbols = np.full(len(c), -1, np.int32)
    symbols[order[:SYMBOL_WORDS]] = np.arange(min(SYMBOL_WORDS, len(c)))
    tokens, words = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    for r in by_class:
        tokens[SYMBOL_WORDS + r["class"]], words[SYMBOL_WORDS + r["class"]] = r["c"], r["n"]
    own = order[:SYMBOL_WORDS]
    np.subtract.at(tokens, SYMBOL_WORDS + classes[own], c[own])
    np.subtract.at(words, SYMBOL_WORDS + classes[own], 1)
    tokens[symbols[own]], words[symbols[own]] = c[own], 1
    tokens[END], words[END] = ends, ends > 0
    masses = tokens + ADD * words
    masses[SYMBOL_WORDS:END] += ADD / CLASSES
    by_hash = np.argsort(hashes)
    weights = np.where(symbols < 0, c + ADD, 0.0)
    within = weights / np.maximum(np.bincount(classes, weights, CLASSES), 1e-300)[classes]
    return Unigrams(int(total), int(different), int(ends), hashes[by_hash], c[by_hash], symbols[by_hash], masses / max(masses.sum(), 1e-300), within[by_hash])


class _Words:
    """What a task remembers of words: symbol, log10 of the base, whether the count is still to be joined."""

    def __init__(self, model: Unigrams) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.place: dict[bytes, int] = {}
        self.symbol, self.log, self.hash, self.open = np.zeros(0, np.uint16), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)
        self.id = np.zeros(0, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        import xxhash

        m = self.model
        hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(m.hashes, hashes), max(0, len(m.hashes) - 1))
        known = m.hashes[at] == hashes if len(m.hashes) else np.zeros(len(words), bool)
        symbols = np.array([_class_of(w) for w in words], np.int64)
        if len(m.hashes):
            symbols = np.where(known & (m.symbols[at] >= 0), m.symbols[at], symbols)
        logs = np.where(known, m.log10(m.counts[at]) if len(m.hashes) else 0.0, 0.0)
        base = len(self.place)
        self.place.update(zip(words, range(base, base + len(words)), strict=True))
        self.symbol = np.concatenate((self.symbol[:base], symbols.astype(np.uint16)))
        self.id = np.concatenate((self.id[:base], np.where(known, at, hashes % UNKNOWN + UNKNOWN).astype(np.uint32)))
        self.log, self.hash, self.open = (np.concatenate((old[:base], new)) for old, new in ((self.log, logs), (self.hash, hashes), (self.open, ~known)))

    def codes(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.place) > MEMO:
            self.reset()
        new = dict.fromkeys(w for words in texts for w in words if w not in self.place)
        if new:
            self.learn(list(new))
        get = self.place.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]


def symbolise(docs: DataFrame, model: Unigrams) -> DataFrame:
    """row, doc_id, key, training, symbols (16-bit) and words (32-bit), both packed, n_tokens, n_known and base over known
    words, and the other words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, key long, training boolean, symbols binary, words binary, n_tokens long, n_known long, base double, others array<struct<h: bigint, n: bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack = _Words(sent.value), zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        end_log, end_known = float(sent.value.log10(sent.value.ends)), int(sent.value.ends > 0)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))]
        for b in batches:
            for group in chunks(zip(b.column(0).to_pylist(), as_bytes(b.column(3)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                rows = []
                for (doc_id, _, key, training), code in zip(group, words.codes([g[1].lower().split() for g in group]), strict=True):
                    unknown = words.open[code]
                    h, n = np.unique(words.hash[code][unknown], return_counts=True)
                    rows.append((doc_id, key, training, pack(words.symbol[code].astype("<u2").tobytes()), pack(words.id[code].astype("<u4").tobytes()), len(code) + 1, int(len(code) - unknown.sum()) + end_known, float(words.log[code].sum()) + end_log, [{"h": x, "n": y} for x, y in zip(h.tolist(), n.tolist())]))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=["doc_id", "key", "training", "symbols", "words", "n_tokens", "n_known", "base", "others"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", row_key().alias("key"), (fold(FOLDS) != HELD_OUT).alias("training"), "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


@dataclass
class Tree:
    """child[s, a]: the state for the context of state s with symbol a before it, or -1; gain[s, x]: log10 of
    P(x | s) / P(x | root); candidate[s, a]: contexts being counted."""

    child: np.ndarray
    probabilities: np.ndarray
    root: np.ndarray
    candidates: np.ndarray | None = field(default=None)

    def states(self, symbols: np.ndarray, depth: int) -> np.ndarray:
        """The longest state of up to ``depth`` symbols before each position; symbols start with DEPTH begins."""
        n = len(symbols) - DEPTH
        state = np.zeros(n, np.int64)
        open_ = np.ones(n, bool)
        for d in range(1, depth + 1):
            before = symbols[DEPTH - d : DEPTH - d + n]
            deeper = np.where(open_, self.child[state, before], -1)
            open_ = deeper >= 0
            state = np.where(open_, deeper, state)
        return state

    def exact(self, symbols: np.ndarray, depth: int) -> np.ndarray:
        """The state of exactly ``depth`` symbols before each position, or -1."""
        n = len(symbols) - DEPTH
        state = np.zeros(n, np.int64)
        for d in range(1, depth + 1):
            before = symbols[DEPTH - d : DEPTH - d + n]
            state = np.where(state >= 0, self.child[np.maximum(state, 0), before], -1)
        return state

    def gain(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(np.log10(self.probabilities / self.root), nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32)


def _padded(binary: list[bytes]) -> np.ndarray:
    """Symbols of several texts after one another, each with its begins in front and its end behind."""
    head, tail = np.full(DEPTH, BEGIN, "<u2").tobytes(), np.full(1, END, "<u2").tobytes()
    return np.frombuffer(b"".join(x for b in binary for x in (head, b, tail)), "<u2").astype(np.int64)


def _count(coded: DataFrame, tree: Tree, depth: int) -> np.ndarray:
    """Counts (candidate, symbol) over all training texts, summed by Spark; bounded by candidates times symbols."""
    sent = coded.sparkSession.sparkContext.broadcast(tree)
    size = int(tree.candidates.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        total = np.zeros(size * SYMBOLS, np.int64)
        for b in batches:
            for group in chunks(enumerate(unpacked(b.column(0)))):
                symbols = _padded([g[1] for g in group])
                state = tree.exact(symbols, depth - 1)
                before = symbols[DEPTH - depth : len(symbols) - depth]
                candidate = np.where(state >= 0, tree.candidates[np.maximum(state, 0), before], -1)
                follows = symbols[DEPTH:]
                used = (candidate >= 0) & (follows != BEGIN)
                total += np.bincount(candidate[used] * SYMBOLS + follows[used], minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 10_000):
            yield pa.record_batch([pa.array(at[k : k + 10_000]), pa.array(total[at[k : k + 10_000]])], names=["code", "n"])

    summed = coded.filter("training").select("symbols").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * SYMBOLS)
    table[summed["code"].to_numpy()] = summed["n"].to_numpy()
    return table.reshape(size, SYMBOLS)


def grow(coded: DataFrame, model: Unigrams, depth: int = DEPTH, share: float = SHARE) -> Tree:
    """Level by level: counts of the candidate contexts, the test against their suffix, and their children."""
    tree = Tree(np.full((1, SYMBOLS), -1, np.int32), model.masses[None, :].copy(), model.masses)
    if not model.total:
        return tree
    least = share * model.total
    everything = np.arange(SYMBOLS)
    level = {(0, int(a)): () for a in everything if a != END}
    follows_of: dict[tuple, np.ndarray] = {}
    for d in range(1, depth + 1):
        if not level:
            break
        tree.candidates = np.full((len(tree.child), SYMBOLS), -1, np.int32)
        for i, (s, a) in enumerate(level):
            tree.candidates[s, a] = i
        counts = _count(coded, tree, d)
        added, grown = [], []
        names = dict(zip(level, counts, strict=True))
        for (s, a), n in names.items():
            total, parent = n.sum(), tree.probabilities[s]
            if total < least:
                continue
            seen = n > 0
            test = 2 * float((n[seen] * np.log(n[seen] / total / np.maximum(parent[seen], 1e-300))).sum())
            kinds = int((parent > 0).sum()) - 1
            if test > kinds + 4 * np.sqrt(2 * kinds):
                added.append((s, a))
                grown.append((n + PRIOR * parent) / (total + PRIOR))
        first = len(tree.child)
        tree.child = np.concatenate((tree.child, np.full((len(added), SYMBOLS), -1, np.int32)))
        for i, (s, a) in enumerate(added):
            tree.child[s, a] = first + i
        if added:
            tree.probabilities = np.concatenate((tree.probabilities, np.array(grown)))
        # Of the next level's contexts the counts are known: what follows a context, read as one longer context.
        paths = {key: (key[1], *level[key]) for key in names}
        follows_of.update({paths[key]: n for key, n in names.items()})
        path = {paths[key]: int(tree.child[key]) for key in added}
        level = {}
        for context, state in path.items():
            for a in everything:
                longer = (int(a), *context)
                known = follows_of.get(longer[:-1])
                if known is not None and known[longer[-1]] >= least and a != END:
                    level[(state, int(a))] = context
    tree.candidates = None
    return tree


def score(docs: DataFrame, depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    counts = cut_lineage(count_words(docs))
    ends = docs.filter(fold(FOLDS) != HELD_OUT).count()
    model = unigrams(counts, ends)
    coded = cut_lineage(symbolise(docs, model))
    tree = grow(coded, model, depth, share)
    sent = spark.sparkContext.broadcast((tree, tree.gain()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, gain = sent.value
        for b in batches:
            gains = np.zeros(b.num_rows)
            for group in chunks(enumerate(unpacked(b.column(0)))):
                symbols = _padded([g[1] for g in group])
                state, follows = tree.states(symbols, depth), symbols[DEPTH:]
                sums = np.concatenate(([0.0], np.cumsum(np.where(follows == BEGIN, 0.0, gain[state, follows].astype(np.float64)))))
                sizes = np.array([len(g[1]) // 2 + 1 + DEPTH for g in group])
                ends = np.cumsum(sizes) - DEPTH
                gains[[g[0] for g in group]] = sums[ends] - sums[ends - (sizes - DEPTH)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(gains)], names=["row", "doc_id", "key", "training", "n_tokens", "n_known", "base", "own", "gain"])

    # Words beyond the broadcast counts: joined by hash, summed by text.  Rows that share id and text have the same
    # words each, so their sums are divided by how many such rows there are.
    others = coded.select("key", F.explode("others").alias("o")).select("key", "o.*")
    weigh = F.log10((F.coalesce("c", F.lit(0)) + ADD) / (model.total + ADD * (model.different + 1))) if model.total else F.lit(0.0)
    joined = others.join(counts.select("h", "c"), "h", "left")
    rest = joined.groupBy("key").agg(F.sum(F.col("n") * weigh).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rest_known"), F.count(F.lit(1)).alias("words"))
    read = coded.select("symbols", "row", "doc_id", "key", "training", "n_tokens", "n_known", "base", F.size("others").alias("own"))
    gained = read.mapInArrow(run, "row long, doc_id long, key long, training boolean, n_tokens long, n_known long, base double, own int, gain double")
    deep = word_gains(coded, model.within, model.total, range(SYMBOL_WORDS, END))
    rows = gained.join(rest, "key", "left").join(deep, "row", "left")
    times = F.when(F.col("own") > 0, F.col("words") / F.col("own")).otherwise(1)
    total = F.col("base") + F.coalesce(F.col("rest") / times, F.lit(0.0))
    return rows.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce((F.col("rest_known") / times).cast("long"), F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        total.alias("base_score"), (total + F.col("gain") + F.coalesce("deep", F.lit(0.0))).alias("score"),
    )
