"""Structured Streaming forms of the event operators.

State is keyed and bounded by watermarks or windows, so a stream may run without end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from skein.operators.store import shared_folder


def read(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The files of that name as a stream with an event time."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    t = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return t.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def gap_sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Sessions that end with a gap (the start-anchored ones are in skein.operators.analytics)."""
    t = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return t.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str = "5 minutes") -> DataFrame:
    """Alerts without repeats within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rate_limited(hits: DataFrame, subject: str, limit: int, seconds: int, late: str = "1 day") -> DataFrame:
    """Each hit with ``allowed``; state per subject is the times of allowed hits within the window, at most ``limit``."""
    window = seconds * 1_000_000

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["t", "event_id"])
        allowed = []
        for t in pdf["t"].tolist():
            log = [x for x in log if x > t - window]
            allowed.append(len(log) < limit)
            if allowed[-1]:
                log.append(t)
        state.update((log,))
        # Behind the window nothing that is kept counts any more.
        state.setTimeoutTimestamp(max(int(pdf["t"].max()) // 1000 + seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"event_id": pdf["event_id"], subject: key[0], "allowed": allowed})

    timed = hits.withWatermark("ts", late).select("event_id", subject, "ts", F.unix_micros("ts").alias("t"))
    return timed.groupBy(subject).applyInPandasWithState(step, f"event_id long, {subject} long, allowed boolean", "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str, folder: str | None = None) -> DataFrame:
    """All that is there now, through the stream and into Parquet in the shared folder, with the stream's own state
    beside it.  A batch that runs again after a failure overwrites what it wrote; in complete mode the last one counts.  A
    source without rows has no batch and gives no rows.  With a ``folder`` of an earlier run the stream goes on from there."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    # An empty batch of its own number, so that there is something to read.
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")
    put = lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch")
    return out.drop("batch")


def error_share(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    bad: Column = F.avg((F.col("event_type") == "error").cast("int"))
    t = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", window, slide).alias("w")).agg(bad.alias("share"), F.count(F.lit(1)).alias("n"))
    return t.select(F.col("w.start").alias("start"), "share", "n")
