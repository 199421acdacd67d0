import corpus_pipeline


def test_stages_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept and kept <= ids, name
        docs, ids = spark.createDataFrame(out.collect(), docs.schema), kept
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().collect()} == ids


def test_one_of_each_group_stays(spark):
    from skein.llm import simhash

    rows = [(5, "a b c d e f", 1), (3, "A  B c d e f", 2), (None, "a b c d e f", 3), (9, "quite another text of words", 4), (9, "quite another text of words", 4), (7, None, 5)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r.doc_id, r.n) for r in kept) == [(3, 2), (7, 5), (9, 4)]


def test_rewritten_texts(spark):
    from skein.llm import repeats

    passage = "".join(chr(97 + i * 7 % 26) for i in range(90)) + "é"
    rows = [(1, f"one {passage}x", 3), (2, f"two {passage}y", 4), (3, None, None)]
    out = {r.doc_id: r for r in repeats.rewrite(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), 40).collect()}
    assert (out[1].text, out[1].n_chars, out[3].text, out[3].n_chars) == ("onex", 4, None, None) and out[2].text == "twoy"


def test_planted_passages_go_and_clean_documents_stay(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(51, 60))) for _ in range(6)]
    clean = [" ".join(word() for _ in range(rng.randint(30, 300))) for _ in range(30)]
    held = [(k, f"{clean[k]} {passages[k % 6]} {' '.join(word() for _ in range(40))}") for k in range(18)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in held + list(enumerate(clean[18:], 18))], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.drop_repeats(spark, docs, "").collect()}
    assert len(out) == 30 and all(p not in out[k].text for k in range(18) for p in passages)
    assert all(out[k].text == clean[k] for k in range(18, 30)) and all(clean[k][:-2] in out[k].text for k in range(18))
    assert corpus_pipeline.drop_repeats(spark, docs.limit(0), "").count() == 0


def test_stages_take_empty_tables_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit(1) for c in ("key", "kept", "root", "score", "ids", "first", "words", "runs")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        out = stage(spark, docs.limit(40), sf)
        assert name == "packing" or out.columns == docs.columns, name
        assert out.count(), name
