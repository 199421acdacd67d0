"""Hooks, policies, quotas, prompts and scores by hand."""

import pytest
from pyspark.sql import functions as F

from skein.operators import reports as R


def test_hooks_that_fail_are_passed_over(spark):
    df, hooks = spark.range(5), R.Hooks()
    hooks.register("pre_query", lambda d: d.withColumn("a", F.lit(1)))
    hooks.register("pre_query", lambda d: d.select("b"))
    hooks.register("pre_query", lambda d: d.drop("id"))
    hooks.register("pre_query", lambda d: 1 / 0)
    hooks.register("on_error", lambda d: d.filter("id < 3"))
    out = hooks.run("pre_query", df, ["id"])
    assert out.columns == ["id", "a"] and out.count() == 3 and [k for k, _ in hooks.failed] == ["pre_query"] * 3
    with pytest.raises(ValueError):
        hooks.register("pre_nothing", lambda d: d)


def test_policies_in_order_on_what_is_left(spark):
    policies = [
        R.Policy("late", 1, ("time_based",), ("query_modification",), {"allowed_hours": [23], "query_prefix": "p"}),
        R.Policy("long", 5, ("query_length",), ("query_modification",), {"max_query_length": 3, "query_suffix": "grown"}),
        R.Policy("brief", 4, ("query_length",), ("logging",), {"max_query_length": 3}),
        R.Policy("all", 0, (), ("rate_limiting",)),
    ]
    rows = spark.createDataFrame([("abc", 23, "free"), ("abcd", 1, "basic")], "q string, h int, t string")
    got = [(r.q, r.applied) for r in R.with_policies(rows, "q", "h", "t", policies).collect()]
    assert got == [("p abc grown", ["long", "late", "all"]), ("abcd", ["all"])]


def test_reservations_of_a_hot_tenant(spark):
    ops = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("k"), F.lit(7).cast("long").alias("n"))
    got = R.reserved(ops, ["k"], ["id"], "n")
    assert {(r.k, r.c) for r in got.filter("allowed").groupBy("k").agg(F.count(F.lit(1)).alias("c")).collect()} == {(1, 7), (2, 7)}
    assert got.agg(F.max("usage")).first()[0] == 7 and got.filter("allowed").agg(F.max("id")).first()[0] == 18


def test_prompts_are_cut_by_the_rule(spark):
    def plain(texts, budget):
        parts, used = [], 0
        for i, t in enumerate(texts, 1):
            t = t.strip()
            part = f"Source {i} (s):\n{t}"
            if used + len(part) > budget:
                left = budget - used - 50
                if left > 100:
                    parts.append(f"Source {i} (s):\n{t[:left]}...")
                break
            parts.append(part)
            used += len(part)
        return "\n\n".join(parts)

    for texts in (["a" * 400, " b" * 200, "c" * 500, "d"], ["x" * 900], ["e" * 480, "f" * 300], ["g"] * 60):
        df = spark.createDataFrame([("k", i, t, "s") for i, t in enumerate(texts)], "k string, i long, t string, s string")
        rows = R.prompt_context(df, "k", "i", "t", "s", 500).collect()
        assert [r.context for r in rows] == [plain(texts, 500)]


def test_scores_by_hand(spark):
    rows = [("What is it", "one two three four five"), ("please describe", "however, a. b c"), ("hm", ""), ("", "x"), ("so", "first. second. third. finally. moreover")]
    df = spark.createDataFrame(rows, "q string, a string")
    got = [(round(r.c, 4), round(r.h, 4)) for r in df.select(R.completeness(F.col("a"), F.col("q")).alias("c"), R.coherence(F.col("a")).alias("h")).collect()]
    assert got == [(0.1, 0.1), (0.04, 0.16), (0.0, 0.0), (0.0, 0.02), (round(5 / 30, 4), 0.62)]
    told = R.threat(F.col("q"), ["BAD"], 0.5, "low")
    odd = spark.createDataFrame([("a bad password: x",), ("x" * 1200,), ("fine",)], "q string")
    assert [(round(r.s, 2), r.sus, r.b) for r in odd.select(told["score"].alias("s"), told["suspicious"].alias("sus"), told["blocked"].alias("b")).collect()] == [(1.0, True, True), (0.8, True, True), (0.1, False, False)]
    assert [r.c for r in spark.createDataFrame([("Query took 3 ms, cache miss",), ("Unauthorized: rate-limit EXCEEDED",), ("ok",)], "m string").select(R.log_classes(F.col("m")).alias("c")).collect()] == [["slow_query", "cache_miss"], ["rate_limit_exceeded", "unauthorized_access"], []]


def test_files_are_validated(spark):
    from skein.operators import documents as D

    rows = [("a/b.pdf", "pdf", "application/pdf", 10), ("a/b.txt", "pdf", "application/pdf", 10), ("x/javascript:y.md", "text", "text/markdown", 0), ("n", "odt", None, 99)]
    told = D.validated(F.col("n"), F.col("k"), F.col("m"), F.col("s"), 50, ["pdf", "text"])
    got = spark.createDataFrame(rows, "n string, k string, m string, s long").select(*[c.alias(n) for n, c in told.items()]).collect()
    assert [(len(r.errors), len(r.warnings), len(r.issues), r.valid) for r in got] == [(0, 0, 0, True), (1, 1, 0, False), (0, 0, 2, False), (1, 1, 0, False)]


def test_functions_that_fail_drop_their_row(spark):
    from skein.operators import documents as D

    df = spark.range(50).select("id", (F.col("id") % 5).alias("k"), F.lit("c").alias("mapped_"))
    got = D.mapped(df, "k", lambda k: 10 // k, "long").collect()
    assert len(got) == 40 and all(r.mapped == 10 // r.k for r in got)
    assert D.mapped(df.limit(0), "k", lambda k: k, "long").count() == 0
    sizes = {r.batch: r["count"] for r in D.in_batches(df, ["id"], 20).groupBy("batch").count().collect()}
    assert sizes == {0: 20, 1: 20, 2: 10}


def test_windows_of_ids(spark):
    import base64

    import public_tokenizers
    import tiktoken

    from skein.operators import chunkers as C

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    texts = [None, "", " \n", "short", "some words and ünïcode ☃ " * 60, "x" * 300]
    for size, overlap in ((16, 4), (5, 9), (1000, 0)):
        step, want = size - min(overlap, size - 1), []
        for i, t in enumerate(texts):
            ids = coder.encode_ordinary(t) if t and t.strip() else []
            at = 0
            while ids:
                want.append((i, at // step, at, len(ids[at : at + size]), coder.decode(ids[at : at + size])))
                if at + size >= len(ids):
                    break
                at += step
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert sorted(tuple(r) for r in C.id_chunks(df, "doc_id", "text", path, public_tokenizers.PATTERN, size, overlap).collect()) == sorted(want)


def test_encoders_get_batches_of_different_texts(spark):
    from skein.operators import vectors as V

    def load():
        def embed(texts):
            assert len(texts) <= 3 and len(set(texts)) == len(texts)
            return [[len(t), t.count("a")] for t in texts]

        return embed

    rows = [(i, t) for i, t in enumerate([None, "", "a  b", "a b", "aa", "x", "yy", "zzz", "aa"] * 3)]
    got = {r.i: r.embedding for r in V.embedded(spark.createDataFrame(rows, "i long, t string").coalesce(1), "i", "t", load, 3).collect()}
    assert got == {i: [float(len(" ".join((t or "").split()))), float((t or "").count("a"))] for i, t in rows}
    assert V.embedded(spark.createDataFrame([], "i long, t string"), "i", "t", load).count() == 0


def test_running_totals_of_a_hot_key(spark):
    from skein.operators import aggregation as A

    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 4).otherwise(None).alias("k"), (F.col("id") % 11).alias("v")).repartition(5)
    sums, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        sums[r.k] = sums.get(r.k, 0) + r.v
        want[r.id] = sums[r.k]
    assert {r.id: r._total for r in A.running_total(df, ["k"], ["id"], "v").collect()} == want
    assert A.running_total(df.limit(0), ["k"], ["id"], "v").count() == 0


def test_advice_by_hand(spark):
    df = spark.createDataFrame([("power_user", ["a", "b", "c", "d"], 31.0), ("none such", [], 5.0)], "s string, t array<string>, m double")
    got = [r.x for r in df.select(R.advice(F.col("s"), F.col("t"), F.col("m")).alias("x")).collect()]
    assert got == [[*R.ADVICE["power_user"], f"{R.MORE_OF} a, b, c", R.IN_DEPTH], [R.OTHERWISE, R.IN_BRIEF]]
