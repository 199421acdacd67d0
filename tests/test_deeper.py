"""Expansion by hand, texts of files, adaptive chunks."""

from pyspark.sql import functions as F

from skein.operators import answers as A
from skein.operators import chunkers, folds, retrieval
from skein.operators import expansion as E
from skein.operators import spans as S
from skein.plans import deeper_queries as D
from skein.plans.registry import ORACLES
from skein.sources import texts

SF = "/root/testdata/sf0.001"


def by_hand(q, most=3):
    once = lambda xs: list(dict.fromkeys(xs))
    syn = [q.replace(h, t) for h, ts in A.SYNONYMS.items() if h in q for t in ts if q.replace(h, t) != q][:most]
    keys = [w for w in q.split() if w not in A.STOP and len(w) > 1]
    terms = once([t for k in keys for t in A.RELATED.get(k, [])])[:most]
    rel = [q.replace(keys[0], t, 1) for t in terms]
    kind = next((k for k, ws in E.KINDS.items() if any(w in q.lower() for w in ws)), "general")
    con = [f"{p} {q}" for p in E.BEFORE[kind]]
    if len(q.strip()) < 3:
        return {k: [q] for k in ("synonyms", "related", "context", "hybrid")} | {"other": [q]}
    lists = {k: once([q, *v])[: most + 1] for k, v in (("synonyms", syn), ("related", rel), ("context", con))}
    return lists | {"hybrid": once([*lists["synonyms"], *lists["related"], *lists["context"]])[: most + 1], "other": [q]}


def test_expansion_by_hand(spark):
    asked = ["یادگیری ماشین چیست", "مشکل سیستم و مشکل داده", "چرا کامپیوتر", "plain words only", "x", "  ", "داده داده امنیت", "کی و کجا", "کاربر a.b(c"]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    for how in ("synonyms", "related", "context", "hybrid", "other"):
        got = {r.q: r.v for r in df.select("q", E.expand(F.col("q"), F.lit(how)).alias("v")).collect()}
        assert got == {q: by_hand(q)[how] for q in asked}, how


def test_wrong_bytes_alone_are_replaced(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("سلام café".encode() + b"\xff end")
    # A file without any character that is whole in UTF-8 is of another encoding.
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_bytes("déjà".encode("latin-1"))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in texts.load(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "سلام café� end", "b.txt": "déjà"}
    latin = {r.path.rsplit("/", 1)[1]: r.text for r in texts.load(spark, str(tmp_path), "ISO-8859-1").collect()}
    assert latin["b.txt"] == "déjà"
    utf16 = tmp_path / "c.txt"
    utf16.write_bytes("ab".encode("utf-16-le") + b"\x00\xd8")
    assert [r.text for r in texts.load(spark, str(utf16), "UTF-16LE").collect()] == ["ab�"]


def test_each_document_by_its_own_strategy(spark):
    rows = [(1, "# T\n## S\n" + "- a | b\n" * 30), (2, "است بود شد است. " * 30), (3, "Some words. " * 900), (4, "short and plain."), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in D.adaptive(docs).orderBy("doc_id", "chunk").collect():
        got.setdefault((r.doc_id, r.strategy), []).append(r.content)
    assert set(got) == {(1, "hierarchical"), (2, "semantic"), (3, "hybrid"), (4, "token")}
    assert got[1, "hierarchical"] == [r.content for r in folds.hierarchical_chunks(docs.filter("doc_id = 1"), "doc_id", "text").orderBy("chunk").collect()]
    assert got[2, "semantic"] == [r.content for r in folds.semantic_chunks(docs.filter("doc_id = 2"), "doc_id", "text").orderBy("chunk").collect()]
    assert got[4, "token"] == ["short and plain."] and all(len(c.split()) <= chunkers.SIZE for c in got[3, "hybrid"]) and len(got[3, "hybrid"]) > 1
    assert S.token_windows(docs, ["doc_id"], "text", 9, 2).filter("doc_id = 5").count() == 0


def test_first_rows_of_a_hot_key(spark, capfd):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(99).alias("k"), ((F.col("id") * 37) % 5003).alias("v"))
    got = {}
    for r in retrieval.first_of_each(df, ["k"], ["v"], 4).collect():
        got.setdefault(r.k, []).append(r.v)
    want = {}
    for r in df.orderBy("v").collect():
        want.setdefault(r.k, []).append(r.v)
    assert {k: sorted(v) for k, v in got.items()} == {k: v[:4] for k, v in want.items()}
    # Each task keeps four rows of a key before the shuffle.
    capfd.readouterr()
    retrieval.first_of_each(df, ["k"], ["v"], 4).explain()
    plan = capfd.readouterr().out
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_long_numbers_are_spread_and_rounded_as_by_sql(spark, tmp_path):
    import random

    import duckdb

    from skein.plans import catalog

    rng = random.Random(1)
    rows = [(k, " ".join(str(rng.randrange(10 ** rng.randrange(1, 18))) for _ in range(rng.randrange(3, 9)))) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    name = "fun14_trends_and_forecasts"
    want = sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
    assert sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()) == want


def test_trees_are_listed_by_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"t/a{k % 3}/b{k}/c").mkdir(parents=True)
        (tmp_path / f"t/a{k % 3}/b{k}/c/x.txt").write_bytes(f"text {k}".encode() + b"\xff" * (k == 7))
    for name in ("t/top.txt", "t/a0/one.txt", "t/a0/_left.txt", "t/.out"):
        (tmp_path / name).write_text(name)
    told = lambda df: sorted((r.path.rpartition("/t/")[2], r.text) for r in df.collect())
    want = told(texts.load(spark, f"{tmp_path}/t"))
    assert len(want) == 42 and told(texts.load_tree(spark, f"{tmp_path}/t")) == want


def test_text_files_of_any_source(spark, tmp_path):
    import duckdb

    rows = [(1, "b", "s/1 %"), (2, None, "s/1 %"), (0, "a\n", "s/1 %"), (50, None, "s/1 %"), (3, "x", None), (4, "é", ""), (5, "y", "%")] + [(60 * k, f"t{k}", "many") for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sparkContext.setJobGroup("text files", "")
    got = {tuple(r) for r in D.text_files(spark, str(tmp_path)).collect()}
    status = spark.sparkContext.statusTracker()
    tasks = sum(s.numTasks for j in status.getJobIdsForGroup("text files") for k in status.getJobInfo(j).stageIds if (s := status.getStageInfo(k)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(ORACLES["src01_27_text_files"]).fetchall()) and len(got) == 305
    assert tasks < 100, tasks
