import random

import numpy as np
import xxhash

from skein.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(prints):
    n = len(prints)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id int")


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t\n", "One", "one", "two words", "É é ÉÉ x y z"]
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(1, 300))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            edited = list(words)
            edited[rng.randrange(len(edited))] = "Edited"
            texts.append("\n".join(edited))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i].fp % 2**64 for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == brute_components(prints)


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = []
    for c in centres:
        for _ in range(12):
            x = int(c)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    edges = simhash.links(df, tile=8)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_components([p % 2**64 for p in prints])
    label = [root.get(fp, fp) for _, fp in rows]
    pairs = {}
    for w, g in zip(want, label, strict=True):
        assert pairs.setdefault(w, g) == g
    assert len(set(want)) == len(set(label))


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_settle_whatever_the_shape(spark):
    rng = random.Random(8)
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 400)] + [(5000, 1200), (5000, 5001)]
    ring = [(2000 + k, 2000 + (k * 7 + 1) % 97) for k in range(97)]
    edges = chain + star + ring
    rng.shuffle(edges)
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
        if all(root[u] == root[v] for u, v in edges):
            break
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_long_text_and_one_whole_row_stays(spark):
    long = " ".join(f"w{k % 977}" for k in range(150_000))
    rows = [(4, long, 1, "b"), (2, long + " end", 2, "a"), (9, "x y", 3, "b"), (9, "x y", 1, "c")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, root int, fp string")).collect()
    assert {(r.doc_id, r.root, r.fp) for r in kept} in ({(2, 2, "a"), (9, 3, "b")}, {(2, 2, "a"), (9, 1, "c")})
