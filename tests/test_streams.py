"""Streams over files: what they give for tables with few rows or none."""

from datetime import datetime, timedelta

from skein.streaming import cache
from skein.streaming import events as S

SF = "/root/testdata/sf0.001"


def test_a_stream_without_rows_gives_none(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    stream = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{tmp_path}/events.parquet")
    timed = stream.withColumn("ts", stream["ts"].cast("timestamp"))
    assert S.run_to_end(S.windowed_counts(timed), "empty-counts", "complete").count() == 0
    assert S.run_to_end(S.rate_limited(timed, "user_id", 3, 60), "empty-limits", "append").count() == 0


def test_state_goes_without_new_events_and_outlives_a_restart(spark, tmp_path):
    start = datetime(2024, 1, 1)

    def put(name, rows):
        spark.createDataFrame([(k, start + timedelta(seconds=s)) for k, s in rows], "k long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema("k long, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        out = S.run_to_end(cache.expiring(stream, "k", "ts", 100, "10 seconds"), "ttl", "append", f"{tmp_path}/run")
        base = int((start - datetime(1970, 1, 1)).total_seconds())
        return {(r.k, r.made // 1_000_000 - base, r.ended // 1_000_000 - base, r.hits) for r in out.collect()}

    # Key 1 is hit twice and made anew at 150; key 2 is never seen again and goes when key 3 moves the time on.
    put("a", [(1, 0), (1, 50), (1, 100), (1, 150), (2, 10)])
    first = run()
    assert (1, 0, 100, 2) in first and not any(k == 3 for k, *_ in first)
    put("b", [(3, 200), (1, 240)])
    second = run()
    assert {(1, 0, 100, 2), (2, 10, 110, 0)} <= second and (1, 150, 250, 1) not in second
    put("c", [(3, 500)])
    assert run() == {(1, 0, 100, 2), (2, 10, 110, 0), (1, 150, 250, 1), (3, 200, 300, 0)}


def test_a_key_gives_one_table_a_batch():
    import pandas as pd

    class Handle:
        def registerTimer(self, at):
            self.timer = at

    class Entry:
        exists = lambda self: False
        update = lambda self, held: setattr(self, "held", held)

    p = cache.Expiring("k", 100)
    p.handle, p.entry = Handle(), Entry()
    tables = list(p.handleInputRows((7,), iter([pd.DataFrame({"t": [900, 0]}), pd.DataFrame({"t": [50, 300, 600]})]), None))
    assert [t.values.tolist() for t in tables] == [[[7, 0, 100, 1], [7, 300, 400, 0], [7, 600, 700, 0]]]
    assert p.entry.held == (900, 0)
