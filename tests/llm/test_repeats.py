import random

import pytest

from skein.llm import queries, repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for k, d in enumerate(data):
        for i in range(len(d) - length + 1):
            seen.setdefault(d[i : i + length], []).append((k, i))
    gone = [set() for _ in data]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + length))
    return [bytes(c for i, c in enumerate(d) if i not in g) for d, g in zip(data, gone)], [sum(i - 1 not in g for i in g) for g in gone]


def texts_with_repeats():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(40))
    texts = [None, "", "short", "a" * 95, "ab" * 70, passage, passage, passage[3:], "x" + passage + "y"]
    for _ in range(40):
        own = [word() for _ in range(rng.randint(1, 90))]
        at = rng.randrange(len(own))
        cut = sorted(rng.sample(range(len(passage)), 2))
        texts.append(" ".join([*own[:at], passage[cut[0] : cut[1]], *own[at:]]))
        if rng.random() < 0.4:
            near = list(texts[-1])
            near[rng.randrange(len(near))] = "Z"
            texts.append("".join(near))
    return texts


@pytest.mark.parametrize(("length", "spread", "crowd"), [(40, 20, 2000), (40, 7, 1), (64, 40, 3)])
def test_matches_brute_force(spark, length, spread, crowd):
    texts = texts_with_repeats()
    docs = spark.createDataFrame([(i, t, f"k{i}", i) for i, t in enumerate(texts)], "doc_id long, text string, key string, s int").repartition(3)
    got = {r.doc_id: r for r in repeats.remove(docs, length, spread, crowd).collect()}
    kept, spans = brute(texts, length)
    assert [bytes(got[i].kept) for i in range(len(texts))] == kept
    assert [len(got[i].spans) for i in range(len(texts))] == spans
    assert all(got[i].key == f"k{i}" for i in range(len(texts)))


def test_pieces_of_a_long_text(spark, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh", k=900))
    data = [(1, text), (2, text[100:700]), (3, text[650:])]
    pieces = lambda size: [(k, t.encode()[at : at + size + 39], at) for k, t in data for at in range(0, len(t) - 39, size)]
    for size in (64, 100, 5000):
        rows = repeats.parse_pieces(pieces(size), 40, 20)
        covered = {k: 0 for k, _ in data}
        for key, n in zip(rows[2], rows[4]):
            covered[int(key)] += int(n)
        assert covered == {k: len(t) - 39 for k, t in data}


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "b" * 30 + "c" * 60), (1, "b" * 30 + "c" * 60), (None, None)], "doc_id long, text string")
    assert [len(r.kept) for r in repeats.remove(docs, 40, 20).collect()] == [0, 0, 0]
    assert repeats.remove(docs.limit(0), 40, 20).count() == 0


def test_query_removes_from_400_bytes_on(spark, tmp_path):
    """A passage of over 50 words is removed by its bytes, not by its words."""
    words = lambda k: "".join(f"{chr(97 + k)}{i:04d} " for i in range(67))
    passage = {n: words(n - 399)[:n] for n in (399, 400)}
    own = iter("0123456789")
    texts = [next(own) * 30 + passage[n] + next(own) * 30 for n in (399, 399, 400, 400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert all(len(p.split()) > 50 for p in passage.values())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in queries.op2_repeated_passages(spark, str(tmp_path)).collect()}
    assert got == {0: (459, 0, 0), 1: (459, 0, 0), 2: (460, 400, 1), 3: (460, 400, 1)}
