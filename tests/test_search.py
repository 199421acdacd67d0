"""Keyword search by blocks against counts of single pairs."""

import random
import re

import pyarrow as pa
import pytest

from skein.operators import retrieval as R


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["the", "Of", "and", *map(str, range(300))]) for _ in range(rng.randrange(30))) for _ in range(n)]


def first(docs, asked, k, last=False):
    out = set()
    for q, words in asked.items():
        n = sorted((-len(words & held), -i if last else i, i) for i, held in docs.items() if words & held)
        out |= {(q, i, -m) for m, _, i in n[:k]}
    return out


@pytest.mark.parametrize("listed", [1, 7, 1 << 21])
def test_slices_and_lists_of_any_size(monkeypatch, listed):
    monkeypatch.setattr(R, "CELLS", 1)
    monkeypatch.setattr(R, "LISTED", listed)
    docs = {i: set(t.lower().split()) for i, t in enumerate(texts(1300, 1))}
    asked = {i: set(t.lower().split()) for i, t in enumerate(texts(9, 2))}
    made = lambda rows: pa.table({"id": pa.array(list(rows), pa.int64()), "words": pa.array([list(w) for w in rows.values()], pa.list_(pa.string()))})
    for ends in ((False,), (False, True)):
        got = {(r["query_id"], r["id"], r["n"]) for r in R._candidates(4, ends)(made(docs), made(asked)).to_pylist()}
        want = set().union(*(first(docs, asked, 4, last) for last in ends))
        assert got == want


def test_blocks_nulls_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(R, "DOCS", 100)
    monkeypatch.setattr(R, "QUERIES", 5)
    docs, asked = dict(enumerate(texts(700, 3))), {f"q{i}": t for i, t in enumerate(texts(12, 4))}
    rows = spark.createDataFrame([*docs.items(), (1000, None), (1001, "")], "id long, text string")
    queries = spark.createDataFrame([*asked.items(), ("none", None)], "q string, text string")
    words = lambda held: {i: set(t.lower().split()) for i, t in held.items()}
    got = {(r.query_id, r.id, r.n) for r in R.keyword_search(rows, queries, "id", "q", "text", 6).collect()}
    assert got == first(words(docs), words(asked), 6)
    # Two rows of one document count together, and so do two rows of one query.
    twice = rows.unionByName(rows.filter("id = 3")), queries.unionByName(queries.filter("q = 'q1'"))
    counts = {(r.query_id, r.id): r.n for r in R.keyword_counts(*twice, "id", "q", "text").collect()}
    assert {(r.query_id, r.id): r.n for r in R.keyword_search(*twice, "id", "q", "text", 1000).collect()} == counts


def test_no_pair_is_shuffled(spark):
    """A word of every text: twenty documents a query and block are passed on, not all."""
    docs = spark.range(3000).selectExpr("id", "'the word' AS text")
    found = R.keyword_candidates(docs, docs.filter("id < 50"), "id", "id", "text", 20)
    blocks = min(spark.sparkContext.defaultParallelism, 3000 // 1024)
    assert found.count() == 50 * 20 * blocks
    assert {r.id for r in R.placed(found, ["id"], 20).collect()} == set(range(20))


def quotes(docs, items, run):
    def runs(t):
        w = [x for x in re.split(r"[ \t\n\v\f\r]+", t.lower()) if x] if t else []
        return {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}

    asked = {i: runs(t) for i, t in items}
    return {(i, d) for d, t in docs for held in [runs(t)] for i in asked if asked[i] & held}


@pytest.mark.parametrize(("run", "hashed"), [(8, 1 << 20), (3, 50), (1, 1)])
def test_quotes_by_hand(spark, monkeypatch, run, hashed):
    monkeypatch.setattr(R, "HASHED", hashed)
    rng = random.Random(run)
    word = lambda: rng.choice(["a", "A", "b", "É", "é", "\u00a0", "ab", "a\u2003b"])
    said = lambda n: "".join(rng.choice([" ", "  ", "\n", "\t\v", "\f\r"]) + word() for _ in range(n)) + rng.choice(["", " "])
    items = [(f"q{i}", said(rng.randrange(30))) for i in range(6)] + [("none", None), ("empty", "")]
    docs = [(i, said(rng.randrange(60))) for i in range(80)]
    # Words of one text never run on into the next, and a part of a word is none.
    docs += [(100, "x" + items[0][1].strip()), (101, items[1][1][:9]), (102, items[1][1][9:]), (103, None), (104, ""), (105, items[2][1].upper())]
    docs += [(i, "long " * 300 + (items[k][1] or "")) for k, i in enumerate(range(200, 206))]
    df = spark.createDataFrame(docs, "d long, text string").repartition(3)
    got = [(r.item, r.id) for r in R.quoting(df, spark.createDataFrame(items, "q string, text string"), "d", "q", "text", run).collect()]
    assert sorted(got) == sorted(quotes(docs, items, run))
    assert R.quoting(df, spark.createDataFrame([], "q string, text string"), "d", "q", "text", run).count() == 0


def test_only_quoted_runs_become_rows(spark):
    """Of 500 texts of 200 words one quotes an item: no row of the others leaves the scan, and nothing but the pair follows."""
    docs = spark.range(500).selectExpr("id", "array_join(transform(sequence(1, 200), x -> concat(id, '-', x)), ' ') AS text")
    items = docs.filter("id = 7").selectExpr("id AS q", "text")
    asked = R.word_runs(items, "q", "text", 8)
    assert R.word_runs(docs, "id", "text", 8).count() == 500 * 193
    passed = R.word_runs(docs, "id", "text", 8, R.marked(asked)).groupBy("id").count().collect()
    # Of 96,307 other runs, 0.3 share a bit with one of the item's 193.
    assert {r.id: r["count"] for r in passed}[7] == 193 and sum(r["count"] for r in passed) < 200


def test_expansion_is_judged_without_rows_of_all_runs(spark, monkeypatch):
    """The query reads the documents' runs once, through the bitmap."""
    from skein.plans import deeper_queries as D

    sent = []
    monkeypatch.setattr(R, "word_runs", lambda *a, f=R.word_runs: sent.append(len(a) > 4) or f(*a))
    plan = D.expansion_evaluation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sent == [False, True]
    assert "Generate explode(array_distinct(transform" not in plan
