import random

from skein.operators import folds
from skein.plans import catalog

SF = "/root/testdata/sf0.001"


def test_groups_may_interleave():
    assert folds.grouped(["a b c", "x y z", "a b d", "x y w"], 0.5) == [[0, 2], [1, 3]]


def quadratic(parts, least):
    groups = []
    words = [set(p.lower().split()) for p in parts]
    for i, w in enumerate(words):
        home = next((g for g in groups if any(len(w & words[j]) / max(1, len(w | words[j])) >= least for j in g)), None)
        groups.append([i]) if home is None else home.append(i)
    return groups


def test_groups_of_long_texts():
    rng = random.Random(4)
    for least, kinds in ((0.3, 40), (0.7, 40), (0.5, 12), (1.0, 6), (0.0, 6)):
        parts = [" ".join(f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(7))) for _ in range(500)]
        assert folds.grouped(parts, least) == quadratic(parts, least)
    assert folds.grouped([], 0.5) == [] and folds.grouped(["a b"] * 90, 0.5) == [list(range(90))]


def test_long_texts_have_no_seams(spark):
    lines = ["alpha beta gamma."] + [f"x{i} y{i} z{i}." for i in range(300)] + ["alpha beta gamma."]
    df = spark.createDataFrame([(1, " ".join(lines))], "id long, t string")
    rows = folds.semantic_chunks(df, "id", "t").collect()
    assert len(rows) == 301 and (rows[0].first, rows[0].last) == (0, 301)


def test_tree_of_headings():
    nodes = folds.tree("# Title\n## One\nshort\nalso short\n## Two\n" + "p" * 2500)
    assert [(level, parent) for level, parent, _ in nodes] == [(1, -1), (2, 0), (3, 1), (2, 0), (3, 3), (4, 4), (4, 4)]
    assert nodes[2][2] == "short\nalso short"


def test_chunks_keep_all_sentences(spark):
    rows = catalog.queries()["chk11_14_semantic_chunks"](spark, SF).collect()
    assert rows and all(r.content and r.first <= r.last for r in rows)
    assert catalog.queries()["chk18_hierarchical_chunks"](spark, SF).count() > 0


def test_folded_keywords(spark):
    df = spark.createDataFrame([(1, "Café, THE café  über-all it"), (2, None)], "id long, t string")
    got = {r.id: r.keywords for r in folds.folded_keywords(df, "id", "t", ["the"]).collect()}
    assert got[1] == ["cafe", "uber", "all", "cafe cafe", "cafe uber", "uber all"] and got[2] == []


def test_hooks_policies_and_uploads(spark):
    from skein.operators import documents as D

    store = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, version int")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, version int")
    assert sorted((r.k, r.v) for r in D.upsert(store, batch, "k").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert [r.k for r in D.delete(store, batch, "k").collect()] == [1]


def test_log_lines(spark):
    from pyspark.sql import functions as F

    from skein.sources import logs

    lines = ["2024-01-01 10:00:00 | ERROR | app:run:12 | it failed | {}", "nonsense", "", "2024-01-01 10:00:00 | INFO | a:b:x | no line number"]
    rows = spark.createDataFrame([(x,) for x in lines], "value string").select(logs.parse(F.col("value")).alias("x")).collect()
    assert rows[0].x.level == "ERROR" and rows[0].x.line == 12 and [r.x for r in rows[1:]] == [None, None, None]


def test_html_by_hand(spark):
    from pyspark.sql import functions as F

    from skein.sources import html

    page = '<html lang="fa"><title>A &amp; B</title><nav>menu</nav><main><h2>Two</h2><p>text</p><script>x</script></main><a href="/r">l</a></html>'
    r = spark.createDataFrame([(page,)], "h string").select(html.content(F.col("h")).alias("c"), html.title(F.col("h")).alias("t"), html.language(F.col("h")).alias("l"), html.links(F.col("h")).alias("a"), html.headings(F.col("h")).alias("hs")).first()
    assert (r.t, r.l, r.a) == ("A & B", "fa", ["/r"]) and "menu" not in r.c and "Two" in r.c and r.hs[0].text == "Two"


def test_trims_take_blanks_alone(spark):
    from pyspark.sql import functions as F

    from skein.operators import chunkers
    from skein.sources import html, logs

    row = spark.createDataFrame([("0 first sentence ends here.   1 second one is longer! ", "  a 0 \n 1 b ", "2024-01-02 03:04:05 | INFO     | app:run:7 | one | two")], "t string, h string, l string")
    got = row.select(chunkers.sentences(F.col("t")).alias("s"), html.normalised(F.col("h")).alias("h"), logs.parse(F.col("l")).alias("l"), logs.parse(F.lit("no | line")).alias("n")).first()
    assert got.s == ["0 first sentence ends here.", "1 second one is longer!"] and got.h == "a 0\n1 b" and got.n is None
    assert (got.l.level, got.l.logger, got.l.function, got.l.line, got.l.message) == ("INFO", "app", "run", 7, "one | two")


def test_ranks_by_ranges(spark):
    import random

    from skein.operators import aggregation

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), k) for k in range(2000)] + [("c", 1, 5000)]
    got = aggregation.ranked(spark.createDataFrame(rows, "k string, v int, id int"), ["k"], ["v", "id"]).collect()
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((v, i) for k, v, i in rows if k == key)
        want |= {i: (n, len(own)) for n, (_, i) in enumerate(own)}
    assert {r.id: (r._i, r._n) for r in got} == want


def test_stores_refuse_what_is_wrong(spark):
    import pytest

    from skein.operators import store

    df = spark.createDataFrame([(1, "a"), (1, "b")], "id int, t string")
    with pytest.raises(ValueError):
        store.save(df, "id")
    path = store.save(df.filter("t = 'a'"), "id")
    assert store.load(spark, path).collect() == df.filter("t = 'a'").collect()
    df.withColumn("_layout", df.id + 1).write.parquet(path + "-other")
    with pytest.raises(ValueError):
        store.load(spark, path + "-other")


def test_text_sources(spark, tmp_path):
    from skein.sources import texts

    (tmp_path / "a.txt").write_bytes("été".encode())
    (tmp_path / "b.txt").write_bytes("été".encode("latin-1"))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in texts.load(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "été", "b.txt": "été"}
    assert [tuple(r) for r in texts.load(spark, "an inline text. With an end").collect()] == [(None, "an inline text. With an end")]
