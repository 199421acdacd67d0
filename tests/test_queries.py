"""Every query with a DuckDB equivalent gives the same rows; the others against small brute-force versions."""

import numpy as np
import pytest

from skein.operators import chunkers
from skein.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, con, name):
    said = oracle.compare(spark, con, SF, name, catalog.queries()[name], catalog.oracle_sql()[name])
    assert said.startswith("ok"), said


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_stream_and_batch_limits_agree(spark):
    batch = {(r.event_id, r.allowed) for r in catalog.queries()["str01_rate_limit"](spark, SF).collect()}
    assert batch == {(r.event_id, r.allowed) for r in catalog.queries()["str01_stream_rate_limit"](spark, SF).collect()}


def test_script_languages(spark):
    from pyspark.sql import functions as F

    from skein.functions import text

    rows = [("hello world", "en"), ("سلام دنیا", "fa"), ("سلام دنیا hello world", "mixed"), ("", "en"), ("123", "en"), ("   ", "en")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", text.script_language(F.col("t")).alias("got")).collect())


def test_merged_chunks():
    assert chunkers.merged(["a" * 300, "b" * 100, "c" * 500]) == ["a" * 300 + "\n" + "b" * 100, "c" * 500]
    assert all(len(c) <= 600 for c in chunkers.merged(["x. " * 900]))


def test_filters_on_missing_fields(spark):
    from skein.operators.filters import Composite, Condition

    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, k string")
    ids = lambda c: [r.id for r in df.filter(c.column()).orderBy("id").collect()]
    assert ids(Condition("k", "eq", "a")) == [2] and ids(Condition("k", "ne", "a")) == [3]
    assert ids(Condition("k", "exists", False)) == [1]
    assert ids(Composite("not", (Condition("k", "eq", "a"),))) == [1, 3]


def test_bucketed_search_finds_neighbours(spark):
    from skein.operators import neighbours as N
    from skein.operators import vectors as V
    from skein.plans.registry import table

    e = table(spark, SF, "embeddings")
    exact = {(r.query_id, r.id) for r in V.batch_topk(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10).collect()}
    got = catalog.queries()["vec05_06_bucketed_search"](spark, SF).collect()
    assert {r.query_id for r in got} == {q for q, _ in exact} and {r["rank"] for r in got} == set(range(1, 11))
    assert len(exact & {(r.query_id, r.id) for r in got}) >= 0.9 * len(exact)
    # Ten clusters: one list of ten holds a vector's neighbours, and all lists together give the exact result.
    rng = np.random.default_rng(1)
    middle = rng.standard_normal((10, 16))
    made = spark.createDataFrame([(i, (middle[i % 10] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(400)], "i long, v array<double>")
    asked = made.filter("i < 40")
    pairs = lambda t: {(r.query_id, r.id, r["rank"]) for r in t.collect()}
    whole = pairs(V.batch_topk(made, asked, "i", "v", 5))
    assert pairs(N.search(made, asked, "i", "v", 5, lists=20, probes=1.0, slack=50.0)) == whole
    assert len(pairs(N.search(made, asked, "i", "v", 5, lists=20, probes=0.3)) & whole) >= 0.9 * len(whole)
    assert N.search(made, asked.limit(0), "i", "v", 5).count() == 0 and N.search(made.limit(0), asked, "i", "v", 5).count() == 0
    # Equal vectors: ties go to the smaller id, as in the exact search.
    same = spark.createDataFrame([(i, [1.0, 0.0, float(i % 2)]) for i in range(40)], "i long, v array<double>")
    assert pairs(N.search(same, same.filter("i < 4"), "i", "v", 3, lists=2, probes=1.0)) == pairs(V.batch_topk(same, same.filter("i < 4"), "i", "v", 3))


@pytest.mark.parametrize("sf,most", [("sf0.01", 0.2), ("sf0.1", 0.15)])
def test_bucketed_search_compares_few_rows(spark, sf, most):
    (r,) = catalog.queries()["vec05_06_measured"](spark, f"/root/testdata/{sf}").collect()
    assert r.recall >= 0.9 and r.compared_share <= most


def test_a_long_batch_is_never_whole_in_python(monkeypatch):
    """Values of a batch become Python objects by slices."""
    import pyarrow as pa

    held = {}

    class Docs:
        columns = ["id", "t"]
        select = lambda self, *_: self
        withColumnRenamed = lambda self, *_: self

        def mapInArrow(self, run, ddl):
            held["run"] = run
            return self

    monkeypatch.setattr(chunkers, "F", type("F", (), {"col": staticmethod(lambda k: type("C", (), {"cast": lambda s, _: s, "alias": lambda s, _: s})())}))
    chunkers.rows_of_texts(Docs(), lambda t: [(0, t)] if t else [], chunk="int", content="string")
    n = 3 * chunkers.AT_ONCE + 1
    batch = pa.record_batch([pa.array(range(n), pa.int64()), pa.array([None, *["x"] * (n - 1)])], names=["id", "t"])
    out = list(held["run"](iter([batch])))
    assert [b.num_rows for b in out] == [chunkers.AT_ONCE - 1, chunkers.AT_ONCE, chunkers.AT_ONCE, 1]


def test_encoded_rows_leave_in_parts(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from skein.operators import vectors as V

    texts = spark.range(3000).select("id", (F.col("id") % 7).cast("string").alias("text")).coalesce(1)
    made = V.embedded(texts, "id", "text", lambda: lambda names: np.array([[float(t), 1.0] for t in names]))
    assert all(r.embedding == [r.id % 7, 1.0] for r in made.collect()) and made.count() == 3000
