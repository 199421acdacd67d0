"""Keyword search, rank fusion, query expansion and packing of context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from skein.functions.text import word_set
from skein.operators.aggregation import running_total
from skein.operators.store import settled

#: Documents and queries of one block, and pairs of them that are counted at once.
DOCS, QUERIES, CELLS = 16384, 2048, 1 << 21
#: Share of a slice's pairs from which on a word is counted by a product of matrices instead of by its pairs.
DENSE = 0.01
#: Pairs of a word's places that are listed at once.
LISTED = 1 << 21
#: Bytes of texts whose words are hashed at once, and bits of the bitmap of the runs that are looked for: 8 MB, whatever
#: their number.
HASHED, SLOTS = 1 << 17, 1 << 26

_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BASE, _STEP, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)

#: English heads and synonyms of our own choice, beside the fixed dictionaries of skein.operators.answers.
SYNONYMS = {"use": ["utilize", "employ", "apply"], "make": ["create", "build", "produce"], "fast": ["quick", "rapid", "speedy"], "the": ["this", "that"], "of": ["from", "about"]}
QUESTION_HEADS = {"what": ["Definition of", "Explanation of", "Meaning of"], "how": ["Steps for", "Guide to", "Method of"], "why": ["Reason for", "Cause of", "Purpose of"], "where": ["Location of", "Place of", "Site of"], "when": ["Time of", "Date of", "Schedule of"]}


def postings(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(term, id): one row for each different word of a document."""
    return docs.select(F.col(id_).alias("id"), F.explode(word_set(F.col(text))).alias("term"))


def first_of_each(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each key, with their ``rank``.  Every task keeps k rows of a key before they meet (Spark's limit
    of a window's groups), so a hot key is never sorted in one task."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def keyword_counts(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text: str) -> DataFrame:
    """(query_id, id, n): how many of a query's different words a document holds, where it holds any."""
    asked = postings(queries, query_id, text).withColumnRenamed("id", "query_id")
    # The words of the queries are few next to those of all documents; Spark broadcasts them if they are small.
    return postings(docs, doc_id, text).join(asked, "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))


def placed(counts: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """The first k of each query, with their rank."""
    return first_of_each(counts, ["query_id"], order, k)


def _dealt(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows with the number of their block, equal ids in one block, and how many blocks there are."""
    n = df.count()
    parts = max(1, -(-n // size), min(df.sparkSession.sparkContext.defaultParallelism, n // 1024) if name == "r" else 1)
    return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), parts


def _postings_of(words: pa.ChunkedArray, number: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and of the term of every word that is a term."""
    lists = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    term = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
    text = np.repeat(number, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return text[term >= 0], term[term >= 0]


def _counts(d: np.ndarray, dt: np.ndarray, q: np.ndarray, qt: np.ndarray, nd: int, nq: int, terms: int) -> np.ndarray:
    """How many words each query and each document of a slice have in common; ``q`` is in the order of ``qt``."""
    of_d, of_q = np.bincount(dt, minlength=terms), np.bincount(qt, minlength=terms)
    dense = of_d * of_q > DENSE * nd * nq
    place = np.cumsum(dense) - 1
    rows, columns = np.zeros((nq, dense.sum()), np.float32), np.zeros((nd, dense.sum()), np.float32)
    own, theirs = dense[qt], dense[dt]
    np.add.at(rows, (q[own], place[qt[own]]), 1)
    np.add.at(columns, (d[theirs], place[dt[theirs]]), 1)
    out = np.rint(rows @ columns.T).astype(np.int64).ravel()
    d, dt = d[~theirs], dt[~theirs]
    first, size = np.cumsum(of_q) - of_q, of_q[dt]
    ends = np.cumsum(size)
    at = 0
    while at < len(d):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LISTED, side="right")))
        n = size[at:stop]
        behind = np.repeat(np.cumsum(n) - n, n)
        found = q[np.repeat(first[dt[at:stop]], n) + np.arange(n.sum()) - behind]
        out += np.bincount(found * nd + np.repeat(d[at:stop], n), minlength=nq * nd)
        at = stop
    return out.reshape(nq, nd)


def _best_of(counts: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and documents of the k largest counts of each query, none of them 0; ties by rank."""
    order = counts * len(rank) + (len(rank) - 1 - rank)
    best = np.argpartition(order, len(rank) - k, axis=1)[:, len(rank) - k :] if len(rank) > k else np.tile(np.arange(len(rank)), (len(counts), 1))
    q = np.repeat(np.arange(len(counts)), best.shape[1])
    held = counts[q, best.ravel()] > 0
    return q[held], best.ravel()[held]


def _candidates(k: int, ends: tuple[bool, ...]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = {"query_id": asked.schema.field("id").type, "id": docs.schema.field("id").type, "n": pa.int64()}
        if not docs.num_rows or not asked.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        terms = pc.unique(asked["words"].combine_chunks().flatten())
        q, qt = _postings_of(asked["words"], np.arange(asked.num_rows), terms)
        q, qt = q[np.argsort(qt, kind="stable")], np.sort(qt)
        # Documents are numbered by the order of their ids; rows of one id are one document.
        ids = docs["id"].combine_chunks().dictionary_encode(null_encoding="encode")
        by_id = pc.sort_indices(ids.dictionary, null_placement="at_start").to_numpy(zero_copy_only=False)
        number = np.argsort(by_id)[ids.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(number, kind="stable")
        docs, number = docs.take(pa.array(order)), number[order]
        width = max(512, CELLS // asked.num_rows)
        found = []
        for start in range(0, len(by_id), width):
            lo, hi = np.searchsorted(number, [start, start + width])
            d, dt = _postings_of(docs["words"].slice(lo, hi - lo), number[lo:hi] - start, terms)
            nd = min(width, len(by_id) - start)
            counts = _counts(d, dt, q, qt, nd, asked.num_rows, len(terms))
            for last in ends:
                rank = np.arange(nd)[::-1] if last else np.arange(nd)
                a, b = _best_of(counts, rank, k)
                found.append(np.stack([a, b + start, counts[a, b], np.full(len(a), last)]))
        a, b, n, last = np.concatenate(found, axis=1)
        # The best of all slices.
        keep = np.lexsort((np.where(last == 1, -b, b), -n, a, last))
        group = last[keep] * asked.num_rows + a[keep]
        keep = keep[np.arange(len(keep)) - np.searchsorted(group, group, side="left") < k]
        a, b, n = np.unique(np.stack([a[keep], b[keep], n[keep]]), axis=1)
        told = ids.dictionary.take(pa.array(by_id[b]))
        return pa.table({"query_id": asked["id"].combine_chunks().take(pa.array(a)), "id": told, "n": pa.array(n, pa.int64())})

    return run


def keyword_candidates(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text: str, k: int, ends: tuple[bool, ...] = (False,)) -> DataFrame:
    """(query_id, id, n): at least the k documents of each query that hold most of its different words, and no document that
    holds none.  Ties at the end go to the smaller id; to the larger one as well, if ``ends`` names True beside False.

    Blocks of documents meet blocks of queries, each pair of blocks keeps k documents a query, and no pair of a document and
    a query is ever a row, however many documents hold a query's words."""
    said = lambda df, id_: df.select(F.col(id_).alias("id"), F.coalesce(word_set(F.col(text)), F.array().cast("array<string>")).alias("words"))
    own, rows = _dealt(said(docs, doc_id), DOCS, "r")
    # Rows of one id are one query.
    once = said(queries, query_id).groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words"))
    asked, blocks = _dealt(once, QUERIES, "q")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = asked.withColumn("r", each(rows))
    schema = StructType().add("query_id", asked.schema["id"].dataType).add("id", own.schema["id"].dataType).add("n", LongType())
    return own.withColumn("q", each(blocks)).groupBy("r", "q").cogroup(sent.groupBy("r", "q")).applyInArrow(_candidates(k, ends), schema)


def keyword_search(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text: str, k: int) -> DataFrame:
    """(query_id, id, n, rank): documents by how many of a query's different words they hold; ties to the smaller id."""
    return placed(keyword_candidates(docs, queries, doc_id, query_id, text, k), [F.desc("n"), "id"], k)


def _mixed(v: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v ^= v >> np.uint64(32)
        v *= _MIX
    return v ^ (v >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for value in (_BASE, pow(_BASE, -1, 2**64)):
        x = np.full(n, value, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _run_hashes(data: np.ndarray, edges: np.ndarray, run: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of every run of so many words; texts lie between the edges, none of them empty."""
    blank, edge = _BLANK[data], np.zeros(len(data) + 1, bool)
    edge[edges] = True
    first = np.flatnonzero(~blank & (edge[:-1] | np.concatenate(([True], blank[:-1]))))
    end = np.flatnonzero(~blank & (edge[1:] | np.concatenate((blank[1:], [True])))) + 1
    text = np.searchsorted(edges, first, side="right") - 1
    # Hashes of words from running sums modulo 2 ** 64.
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0][: len(data)], out=sums[1:])
    word = _mixed((sums[end] - sums[first]) * powers[1][first])
    n = max(0, len(word) - run + 1)
    total = np.zeros(n, np.uint64)
    for k in range(run):
        total = total * _STEP + word[k : k + n]
    whole = np.flatnonzero(text[:n] == text[run - 1 :]) if n else np.arange(0)
    return text[whole], _mixed(total[whole])


def _runs_of(run: int, sent=None):
    """(id, run) of (id, text); of the runs in the bitmap, if one was sent."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = _powers(HASHED), sent and sent.value
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0]
            data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) else None
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + HASHED, side="right")) - 1)
                part = data[ends[at] : ends[stop]]
                if len(part) > len(powers[0]):
                    powers = _powers(len(part))
                text, runs = _run_hashes(part, ends[at : stop + 1] - ends[at], run, powers)
                if bits is not None:
                    slot = runs & np.uint64(SLOTS - 1)
                    held = np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    text, runs = text[held], runs[held]
                if len(runs):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + text)), pa.array(runs.view(np.int64))], names=["id", "run"])
                at = stop

    return found


def word_runs(df: DataFrame, id_: str, text: str, run: int, sent=None) -> DataFrame:
    """(id, run): a hash of every run of so many words of a text, in any case."""
    schema = StructType().add("id", df.schema[id_].dataType).add("run", LongType())
    # So many words are twice as many bytes less one, in capitals too; a filter behind lower() would call it twice.
    long = df.filter(F.octet_length(F.col(text)) >= 2 * run - 1)
    return long.select(F.col(id_).alias("id"), F.lower(F.col(text)).alias("text")).mapInArrow(_runs_of(run, sent), schema)


def marked(runs: DataFrame):
    """A bitmap of SLOTS bits, broadcast, in which the slot of each run is set."""
    slot = F.col("run").bitwiseAND(F.lit(SLOTS - 1))
    # Spark builds bitmaps of 4096 bytes.
    rows = runs.groupBy(F.shiftright(slot, 15).alias("at")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")).toArrow()
    bits = np.zeros((SLOTS >> 15, 4096), np.uint8)
    for at, held in zip(rows["at"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        bits[at] = np.frombuffer(held, np.uint8)
    return runs.sparkSession.sparkContext.broadcast(bits.ravel())


def quoting(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, run: int) -> DataFrame:
    """(item, id): which documents share a run of so many words with which items, once each.

    The items' runs are hashed and marked in a bitmap of fixed size, and only such runs of documents become rows.  The more
    items, the fuller the bitmap and the more rows are sent to the join in vain; the result is the same."""
    asked = settled(word_runs(items, item_id, text, run).distinct().toDF("item", "run"))
    return asked.join(word_runs(docs, doc_id, text, run, marked(asked)), "run").select("item", "id").distinct()


def fuse(semantic: DataFrame, keyword: DataFrame, alpha: Column | float, keys: list[str]) -> DataFrame:
    """Two ranked lists (keys, rank) by position: 1 - i / n each, alpha for the first list."""
    place = lambda df, name: df.select(*keys, (1 - (F.col("rank") - 1) / F.count(F.lit(1)).over(Window.partitionBy(keys[0]))).alias(name))
    both = place(semantic, "semantic").join(place(keyword, "keyword"), keys, "full")
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return both.fillna(0.0, ["semantic", "keyword"]).withColumn("score", a * F.col("semantic") + (1 - a) * F.col("keyword"))


def fuse_scores(semantic: DataFrame, keyword: DataFrame, alpha: float, keys: list[str]) -> DataFrame:
    """Score-weighted fusion; what only the keywords found counts (1 - alpha) of its score."""
    both = semantic.join(keyword, keys, "full").fillna(0.0, ["cosine", "hits"])
    return both.withColumn("score", alpha * F.col("cosine") + (1 - alpha) * F.col("hits"))


def first_seen(df: DataFrame, order: list[str], *keys: Column) -> DataFrame:
    """Rows whose keys no earlier row has, one key after another."""
    for key in keys:
        w = Window.partitionBy(key).orderBy(*order)
        df = df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return df


def expand_synonyms(c: Column, most: int = 3) -> Column:
    low = F.lower(c)
    variants = [F.when(F.contains(low, F.lit(head)), F.replace(low, F.lit(head), F.lit(other))) for head, others in SYNONYMS.items() for other in others]
    return F.slice(F.array_compact(F.array(*variants)), 1, most)


def expand_context(c: Column) -> Column:
    low = F.lower(F.trim(c))
    out = None
    for head, prefixes in QUESTION_HEADS.items():
        variants = F.array(*[F.concat(F.lit(f"{p} "), low) for p in prefixes])
        out = F.when(F.startswith(low, F.lit(head)), variants) if out is None else out.when(F.startswith(low, F.lit(head)), variants)
    return out.otherwise(F.array(*[F.concat(F.lit(f"{p} "), low) for p in ("Information about", "Details of", "Overview of")]))


def expand(c: Column, most: int = 4) -> Column:
    """The query, its synonyms and its context variants, different ones only; blank and short queries stay alone."""
    every = F.slice(F.array_distinct(F.concat(F.array(c), expand_synonyms(c), expand_context(c))), 1, most)
    return F.when(F.length(F.trim(c)) < 3, F.array(c)).otherwise(every)


def within_budget(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows whose running cost is within the budget, and what was left before each; a hot key is added up by ranges."""
    used = running_total(df, keys, order, cost).withColumnRenamed("_total", "used")
    return used.withColumn("left", budget - (F.col("used") - F.col(cost))).filter(F.col("left") > 0)
