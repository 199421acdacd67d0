"""Markdown, languages, quantiles of histograms and predicate trees, by hand and by chance."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.functions import language as L
from skein.operators import analytics as A
from skein.operators import predicates as P
from skein.operators.filters import Condition
from skein.plans.registry import table
from skein.sources import markdown as M

MARKDOWN = [
    ("", ""),
    (None, ""),
    ("plain\n\nlines  \n", "plain\nlines"),
    ("# H #\n## Second\n####### seven", "H\nSecond\n####### seven"),
    ("a **b** _c_ `d*e*` f", "a\nb\nc\nd*e*\nf"),
    ("***both*** and **one *two* three**", "both\nand\none\ntwo\nthree"),
    ("snake_case and 2 * 3 * 4", "snake_case and 2 * 3 * 4"),
    ("```\n# no heading\n\n  * no list\n```\nafter", "# no heading\n* no list\nafter"),
    ("~~~py\n```\nin\n~~~ not yet\n~~~~\nout", "```\nin\n~~~ not yet\nout"),
    ("```\nnever closed\n| a |", "never closed\n| a |"),
    ("``` a `b` `` c`d `` e", "``` a\nb\nc`d\ne"),
    ("> q\n>> r\n> - s", "q\nr\ns"),
    ("1. one\n   - two\n10) three", "one\ntwo\nthree"),
    ("| a | b |\n|---|:-:|\n| 1 | *2* |\n\nx | y", "a\nb\n1\n2\nx | y"),
    ("a | b\n--|--\n1 | 2", "a\nb\n1\n2"),
    ("Title\n===\nSub\n---\ntext\n***\n- - -", "Title\nSub\ntext"),
    ("![no](i.png) [yes](u \"t\") <http://x.y/z>", "yes\nhttp://x.y/z"),
    ("[ref]: http://y\n[t][ref]", "t"),
    ("\\*a\\* \\# b \\`c\\`", "*a* # b `c`"),
    ("&lt;b&gt; &amp; <i>x</i>", "<b> &\nx"),
    ("one ` tick and `code` ", "one\ntick and\ncode`"),
    ("a\r\nb\rc", "a\nb\nc"),
]


def test_markdown_by_hand(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(MARKDOWN)], "id long, md string")
    got = {r.id: r.text for r in M.to_text(df, ["id"], "md").collect()}
    assert [got[i] for i in range(len(MARKDOWN))] == [t for _, t in MARKDOWN]
    assert M.to_text(df.limit(0), ["id"], "md").count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_languages_outside_the_sample(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    found = L.voted(docs, "text", L.fitted(docs, "doc_id", "text", "lang"))
    share = found.filter(~L.sampled("doc_id", L.SAMPLE, docs.count())).agg(F.avg((F.col("lang") == F.col("language")).cast("int")).alias("x"), F.count(F.lit(1)).alias("n")).first()
    assert share.x >= 0.95 and share.n > 500


def test_votes_by_hand():
    english, spanish = "the house and the garden of the town is there with them " * 9, "la casa y el jardín de la ciudad está allí con ellos que son " * 9
    profiles = {"en": L.ranks(L.grams(english)), "es": L.ranks(L.grams(spanish))}
    assert L.vote("the town and the house", profiles) == "en" and L.vote("la ciudad", profiles) == "es"
    assert L.vote("", profiles) is None and L.vote("12 %", profiles) is None and L.vote("the", {}) is None
    # Two thirds against one.
    assert L.vote(english * 30 + spanish * 10, profiles) == "en" and L.vote(english * 10 + spanish * 40, profiles) == "es"
    assert "".join(dict.fromkeys(L.parts("x" * 10))) and all(len(p) >= L.PART for p in L.parts("y" * 9000))
    assert L.grams("Ab ab") == Counter({"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2})


def test_quantiles_of_histograms(spark):
    rows = [("a", v) for v in (0.5, 1.5, 1.5, 9.0)] + [("b", 100.0)] * 3 + [("c", None)] + [("d", 4.5), ("d", 4.6)]
    h = A.histogram(spark.createDataFrame(rows, "k string, v double"), [F.col("k")], "v", [1.0, 2.0, 4.0, 8.0])
    q = lambda s: {r.k: r.q for r in h.select("k", A.histogram_quantile(s, F.col("buckets"), [1.0, 2.0, 4.0, 8.0]).alias("q")).collect()}
    # a: one, two, none, none and one beyond; the empty buckets between are passed over.
    assert q(0.5) == {"a": 1.5, "b": 8.0, "d": 6.0} and q(0.75) == {"a": 2.0, "b": 8.0, "d": 7.0} and q(0.95)["a"] == 8.0
    assert q(0.25)["a"] == 1.0
    low = spark.createDataFrame([(-1.0,), (3.0,)], "v double")
    assert A.histogram(low, [], "v", [0.0, 5.0]).select(A.histogram_quantile(0.5, F.col("buckets"), [0.0, 5.0])).first()[0] == 0.0


def random_tree(draw, depth=0):
    if depth == 3 or draw.random() < 0.4:
        return draw.choice([
            Condition("n", draw.choice(["eq", "ne", "gt", "gte", "lt", "lte"]), draw.randrange(9)),
            Condition("n", draw.choice(["in", "nin"]), tuple(draw.sample(range(9), 3))),
            Condition("s", "contains", draw.choice("abc")),
            Condition("s", "regex", draw.choice(["^A", "b$", "c.a"]), draw.random() < 0.5),
            Condition(draw.choice("ns"), "exists", draw.random() < 0.5),
            Condition("n", "range", (draw.randrange(5), draw.randrange(4, 9))),
            Condition("place", "geo", (1.0, 2.0, draw.choice([50.0, 200.0]))),
        ])
    parts = [random_tree(draw, depth + 1) for _ in range(draw.randrange(1, 4))]
    return P.Group(draw.choice(["and", "or", "not"]), tuple(p for p in parts if isinstance(p, Condition)), tuple(p for p in parts if isinstance(p, P.Group)))


def plain(tree, row):
    """Whether a row matches, told without Spark."""
    import math
    import re

    if isinstance(tree, P.Group):
        found = [plain(p, row) for p in tree.parts()]
        return all(found) if tree.logic == "and" else any(found) if tree.logic == "or" else not any(found)
    value, v = row[tree.field], tree.value
    if tree.op == "exists":
        return (value is not None) == v
    if value is None:
        return False
    if tree.op == "geo":
        lat, lon = map(math.radians, value)
        a = math.sin((lat - math.radians(v[0])) / 2) ** 2 + math.cos(lat) * math.cos(math.radians(v[0])) * math.sin((lon - math.radians(v[1])) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(a)) <= v[2]
    how = {"eq": lambda: value == v, "ne": lambda: value != v, "gt": lambda: value > v, "gte": lambda: value >= v, "lt": lambda: value < v, "lte": lambda: value <= v, "in": lambda: value in v, "nin": lambda: value not in v, "contains": lambda: v in value, "regex": lambda: bool(re.search(v, value, re.I if tree.ignore_case else 0)), "range": lambda: v[0] <= value <= v[1]}
    return how[tree.op]()


def test_random_trees_and_their_documents(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice([None, *range(9)]), draw.choice([None, "", "Abca", "ab", "CxA", "bcb"]), draw.choice([None, (1.0, 2.0), (1.5, 2.5), (4.0, 4.0)])) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, n int, s string, place struct<lat:double,lon:double>").cache()
    trees = [random_tree(draw) for _ in range(40)]
    told = df.select("id", *[P.column(t).alias(f"a{k}") for k, t in enumerate(trees)], *[P.column(P.read(P.document(t))).alias(f"b{k}") for k, t in enumerate(trees)]).collect()
    by_id = {i: {"n": n, "s": s, "place": p} for i, n, s, p in rows}
    for k, t in enumerate(trees):
        want = {i for i, row in by_id.items() if plain(t, row)}
        assert {r.id for r in told if r[f"a{k}"]} == want == {r.id for r in told if r[f"b{k}"]}, P.document(t)


def test_where_documents():
    assert P.where({"a": 1}) == {"a": {"$eq": 1}} and P.where({"a": [1, 2]}) == {"a": {"$in": [1, 2]}} and P.where(None) == {} == P.where({"a": {"$x": 1}})
    assert P.where({"a": 1, "b": {"$gt": 2, "$x": 3}}) == {"$and": [{"a": {"$eq": 1}}, {"b": {"$gt": 2}}]}
    assert P.where({"$or": [{"a": 1}]}) == {"$or": [{"a": 1}]}
    with pytest.raises(ValueError):
        P.read({"a": {"$x": 1}})


def test_references_without_semicolon_stay():
    from skein.sources import pages as PG

    said = PG.main_text("<title>a &amp;&amp</title><p>b &lt; c &ampd; &unknown; &#39;x&#39 &copy</p>", PG.FILE_MAIN)
    assert said == "a &&amp\nb < c &ampd; &unknown; 'x&#39 &copy"


def test_grams_of_words_are_cut_once(monkeypatch):
    from collections import Counter

    from skein.functions import language as LG

    text = "Ab c\u00e9, ab! \u00c0\u00c9 9x\u00b2y " + "long" * 20 + " ab ab"
    want: Counter = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        want.update(g for size in (1, 2, 3) for i in range(len(padded) - size + 1) if (g := padded[i : i + size]) != " ")
    assert LG.grams(text) == want
    assert list(LG.ranks(want)) == [g for g, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[: LG.TOP]]
    before = LG._grams_of.cache_info()
    LG.grams(text)
    after = LG._grams_of.cache_info()
    assert after.misses == before.misses and after.hits > before.hits


def test_markdown_shuffles_nothing_and_parts_code_of_one_kind(spark, capfd):
    # A private character of the text parts nothing, rows of one key stay apart, and what a fence holds keeps its marks.
    rows = [(1, "ab *c*\n`d`"), (1, "```\n\t\\* <b> & `x` | \n```\n| a |\n|---|\n| \\| |"), (2, "*a\nb* _c\nd_ [e\n](f) <g\nh>")]
    df = M.to_text(spark.createDataFrame(rows, "id long, md string"), ["id"], "md")
    assert sorted(r.text for r in df.collect()) == sorted(["ab\nc\nd", "\t\\* <b> & `x` | \na\n|", "*a\nb* _c\nd_ [e\n](f) <g\nh>"])
    df.explain()
    assert "Exchange" not in capfd.readouterr().out
