"""A cache as a stream: entries with time to live, kept as state and evicted by timers.

An entry is made by the first access of its key and serves accesses for ``ttl``; later ones make a new entry, as accesses
don't renew it.  State is one entry a key, in a RocksDB state store, and goes when the watermark has passed its end,
whether or not its key is seen again.  The batch form is :func:`entries`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.operators.scans import Sessions, scan

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Expiring(StatefulProcessor):
    """Gives each entry when it is evicted: its key, when it was made and ended, and the accesses that it served."""

    def __init__(self, key: str, ttl: int) -> None:
        self.key, self.ttl = key, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "made long, hits long")

    def _rows(self, key, held: list[tuple[int, int]]) -> pd.DataFrame:
        made, hits = zip(*held, strict=True)
        return pd.DataFrame({self.key: [key[0]] * len(made), "made": made, "ended": [m + self.ttl for m in made], "hits": hits})

    def _keep(self, made: int, hits: int) -> None:
        self.entry.update((made, hits))
        # In milliseconds, and not before the end.
        self.handle.registerTimer((made + self.ttl) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        made, hits = held if held else (None, 0)
        over: list[tuple[int, int]] = []
        for t in sorted(t for pdf in rows for t in pdf["t"].tolist()):
            if made is not None and t - made <= self.ttl:
                hits += 1
                continue
            if made is not None:
                over.append((made, hits))
            made, hits = t, 0
        if held and over:
            self.handle.deleteTimer((held[0] + self.ttl) // 1000 + 1)
        self._keep(made, hits)
        # One table a key: one an entry costs a table and a message for almost every access.
        if over:
            yield self._rows(key, over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            made, hits = self.entry.get()
            self.entry.clear()
            yield self._rows(key, [(made, hits)])

    def close(self) -> None:
        pass


def expiring(accesses: DataFrame, key: str, ts: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, made, ended, hits) of evicted entries, in microseconds; ``accesses`` is a stream."""
    spark = accesses.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = accesses.withWatermark(ts, late).select(key, ts, F.unix_micros(ts).alias("t"))
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=Expiring(key, seconds * 1_000_000), outputStructType=f"{key} {timed.schema[key].dataType.simpleString()}, made long, ended long, hits long", outputMode="Append", timeMode="EventTime")


def entries(accesses: DataFrame, key: str, ts: str, seconds: int, late_seconds: int = 600) -> DataFrame:
    """The same of a table: the entries that have ended when everything was read."""
    started = scan(accesses.select(key, ts), key, ts, [], Sessions(seconds * 1_000_000), "long").withColumnRenamed("value", "made")
    held = started.groupBy(key, "made").agg((F.count(F.lit(1)) - 1).alias("hits")).withColumn("ended", F.col("made") + seconds * 1_000_000)
    mark = accesses.agg(((F.unix_micros(F.max(ts)) / 1000).cast("long") - late_seconds * 1000).alias("mark"))
    over = (F.col("ended") / 1000).cast("long") + 1 <= F.col("mark")
    # One that a later access of its key ended is over as well.
    return held.withColumn("_next", F.lead("made").over(Window.partitionBy(key).orderBy("made"))).crossJoin(mark).filter(over | F.col("_next").isNotNull()).select(key, "made", "ended", "hits")
