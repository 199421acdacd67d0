import pytest

from skein.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, name):
    sf = "/root/testdata/sf0.001"
    said = oracle.compare(spark, oracle.duck(sf), sf, name, queries.queries()[name], queries.oracle_sql()[name])
    assert said.startswith("ok"), said


def test_files_with_several_notices(spark, tmp_path):
    """Notices alone, by twos, by threes and all at once, whole, torn and with their phrases broken."""
    import random

    import duckdb

    from skein.llm import licenses, oracles

    draw = random.Random(8)
    notices = [text for _, text, _ in licenses.TEMPLATES]
    texts = [None, "", *notices, " filler words ".join(notices)]
    texts += [" and so on, ".join(draw.sample(notices, n)) for n in (2, 3, 5) for _ in range(25)]
    texts += [" ".join(w for w in t.split() if draw.random() < 0.8) for t in texts[2:] for _ in range(2)]
    texts += ["word " * 3000 + notices[0] + " word" * 3000, notices[3].upper(), "license 2 0 the license version 4 0 software"]
    rows = [(i // 2 if i < 6 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    # The SQL tells rows by their id, so the few that share one are asked for by Spark alone.
    assert licenses.scan(df).count() == len(rows)
    alone = df.filter("doc_id >= 3")
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('" + f"{tmp_path}/documents.parquet/*.parquet" + "') WHERE doc_id >= 3")
    got = oracle.rows_of(licenses.scan(alone).columns, [tuple(r) for r in licenses.scan(alone).collect()])
    cursor = con.execute(oracles.license_scan())
    want = oracle.rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert got == want
    labels = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    every = {label for label, _, _ in licenses.TEMPLATES}
    assert every <= set(labels[rows[16][0]].split(","))
