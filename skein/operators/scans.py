"""Ordered folds over events that no hot subject holds up.

Rows are dealt by ranges of subject and order, so a subject with a third of all rows lies in many ranges.  Each range gives
a summary of one row: its first and its last subject, and what the fold's state is behind it.  That is known where the last
subject begins in the range; else the fold says how the state behind depends on the state before, or that it doesn't.
The summaries, one a range, are put in order, which gives every range the state its first subject begins with; then all
ranges are folded side by side.  A range whose summary can't say (the subject never paused long enough in it) is folded
ahead by itself, in order: that is as sequential as the rule is, but no task ever reads more than one range.

A fold is a :class:`Fold`; its state is small and doesn't grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.aggregation import ranked
from skein.operators.analytics import micros
from skein.operators.store import settled


class Fold:
    """Reads one subject's rows in order: times in microseconds and marks."""

    #: The state before a subject's first row.
    fresh: Any = None

    def read(self, state: Any, times: list[int], marks: list) -> tuple[list, Any]:
        """What each row gives, and the state behind them.  ``state`` isn't changed."""
        raise NotImplementedError

    def summary(self, times: np.ndarray, marks: list) -> Any:
        """What is known of the state behind these rows, whatever the state before; None for nothing."""
        raise NotImplementedError

    def behind(self, summary: Any, state: Any) -> Any:
        """The state behind the summed up rows, from the state before."""
        return summary


class Sessions(Fold):
    """A row gives the start of its session: a session ends with the first row over ``limit`` after its start.

    The state is the start of the open session.  A range's first new session starts at one of the rows within ``limit`` of
    its first row, or at none; the summary has, for each of these, the start of the session that is open at the end."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def read(self, state, times, marks):
        out = []
        for t in times:
            if state is None or t - state > self.limit:
                state = t
            out.append(state)
        return out, state

    def summary(self, times, marks):
        firsts = np.unique(times[times <= times[0] + self.limit])
        ends = []
        for start in [*firsts.tolist(), *times[times > times[0] + self.limit][:1].tolist()]:
            while (at := int(np.searchsorted(times, start + self.limit, side="right"))) < len(times):
                start = int(times[at])
            ends.append(start)
        return firsts.tolist(), ends

    def behind(self, summary, state):
        firsts, ends = summary
        if state is None or firsts[0] - state > self.limit:
            return ends[0]
        # The first row that the open session doesn't reach.
        at = int(np.searchsorted(firsts, state + self.limit, side="right"))
        return ends[at] if at < len(ends) else state


class Limited(Fold):
    """A row gives whether it is allowed: fewer than ``limit`` allowed ones lie within ``window`` before it.

    The state is the times of allowed rows within the window.  Where fewer than ``limit`` rows of any kind lie within two
    windows, all those of the last window were allowed, so the state is known there."""

    def __init__(self, limit: int, window: int) -> None:
        self.limit, self.window, self.fresh = limit, window, ()

    def read(self, state, times, marks):
        from collections import deque

        log, out = deque(state), []
        for t in times:
            while log and log[0] <= t - self.window:
                log.popleft()
            out.append(len(log) < self.limit)
            if out[-1]:
                log.append(t)
        return out, tuple(log)

    def summary(self, times, marks):
        held = np.arange(1, len(times) + 1) - np.searchsorted(times, times - 2 * self.window, side="right")
        sure = np.flatnonzero((held < self.limit) & (times - times[0] >= 2 * self.window))
        if not len(sure):
            return None
        at = int(sure[-1])
        log = times[: at + 1][times[: at + 1] > times[at] - self.window]
        return self.read(tuple(log.tolist()), times[at + 1 :].tolist(), marks[at + 1 :])[1]


class Alerts(Fold):
    """A row marked bad raises an alert unless one is active, the last was raised under ``cool_down`` ago, or ``hourly``
    were raised within the hour; a good one resolves an active alert.

    The state is whether an alert is active, and the times raised within the hour.  A good row with no bad one in the hour
    before leaves nothing open."""

    HOUR = 3_600_000_000

    def __init__(self, cool_down: int, hourly: int) -> None:
        self.cool_down, self.hourly, self.fresh = cool_down, hourly, (False, ())

    def read(self, state, times, marks):
        (active, raised), out = state, []
        for t, bad in zip(times, marks, strict=True):
            raised = tuple(x for x in raised if x > t - self.HOUR)
            if not bad:
                out.append("resolved" if active else "quiet")
                active = False
            elif active or len(raised) >= self.hourly or (raised and t - raised[-1] < self.cool_down):
                out.append("suppressed")
            else:
                out.append("raised")
                active, raised = True, (*raised, t)
        return out, (active, raised)

    def summary(self, times, marks):
        bad = np.concatenate(([0], np.cumsum(np.array([bool(m) for m in marks]))))
        before = bad[1:] - bad[np.searchsorted(times, times - self.HOUR, side="right")]
        sure = np.flatnonzero((before == 0) & (times - times[0] >= self.HOUR))
        if not len(sure):
            return None
        at = int(sure[-1])
        return self.read(self.fresh, times[at + 1 :].tolist(), marks[at + 1 :])[1]


class TwoLevels(Fold):
    """A row gives what answers an access: first (set or asked within ``first``), second (set within ``second``; the first
    level holds it again), or miss, which sets both.  A marked row invalidates: gone, or nothing if there was none.

    The state is when the first level got the entry and when it was set.  After a pause over ``second`` nothing is left."""

    def __init__(self, first: int, second: int) -> None:
        self.first, self.second = first, second

    def read(self, state, times, marks):
        out = []
        for t, mark in zip(times, marks, strict=True):
            alive = state is not None and (t - state[0] <= self.first or t - state[1] <= self.second)
            if mark:
                out.append("gone" if alive else "nothing")
                state = ()
            elif alive and state and t - state[0] <= self.first:
                out.append("first")
            elif alive:
                out.append("second")
                state = (t, state[1])
            else:
                out.append("miss")
                state = (t, t)
            state = state or None
        return out, state

    def summary(self, times, marks):
        apart = np.concatenate(([False], np.diff(times) > max(self.first, self.second)))
        sure = np.flatnonzero(apart | np.array([bool(m) for m in marks]))
        if not len(sure):
            return None
        at = int(sure[-1])
        # Told as a list, as no entry is a state as well.
        return [self.read(None, times[at:].tolist(), marks[at:])[1]]

    def behind(self, summary, state):
        return summary[0]


def _runs(subjects: list) -> Iterator[tuple[int, int]]:
    """Where each subject's rows begin and end in a batch."""
    at = 0
    for k in range(1, len(subjects) + 1):
        if k == len(subjects) or subjects[k] != subjects[at]:
            yield at, k
            at = k


def _summed(fold: Fold):
    """One row a range: number, first and last subject, whether they differ, and a pickled state or summary."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, subjects, times, marks, state, many = None, [], [], [], fold.fresh, False
        for b in batches:
            if not b.num_rows:
                continue
            who, t, m = (b.column(c).to_pylist() for c in ("_subject", "_t", "_mark"))
            if number is None:
                number, subjects = b.column("_range")[0].as_py(), [who[0], who[0]]
            for i, j in _runs(who):
                if who[i] != subjects[1]:
                    subjects[1], state, many = who[i], fold.fresh, True
                    times, marks = [], []
                if many:
                    state = fold.read(state, t[i:j], m[i:j])[1]
                else:
                    times.append(np.array(t[i:j], np.int64))
                    marks += m[i:j]
        if number is not None:
            said = state if many else fold.summary(np.concatenate(times), marks)
            yield pa.record_batch([pa.array([number], pa.int64()), pa.array([subjects[0]], pa.string()), pa.array([subjects[1]], pa.string()), pa.array([many]), pa.array([pickle.dumps(said)], pa.binary())], names=["number", "first", "last", "many", "said"])

    return run


def _starts(dealt: DataFrame, fold: Fold) -> dict[int, tuple[str, Any]]:
    """For each range whose first subject began before it: that subject and its state."""
    import pickle

    context = dealt.sparkSession.sparkContext
    columns = ["_range", "_subject", "_t", "_mark"]
    rows = dealt.select(*columns).mapInArrow(_summed(fold), "number long, first string, last string, many boolean, said binary").orderBy("number").collect()
    said = {r.number: pickle.loads(bytes(r.said)) for r in rows}
    goes_on = [k > 0 and rows[k - 1].last == r.first for k, r in enumerate(rows)]
    behind = {r.number: said[r.number] for r in rows if r.many}

    def ahead(part) -> Iterator[tuple[int, Any]]:
        """Folds one range from its known state on."""
        number, state = None, None
        while held := list(islice(part, 4096)):
            if number is None:
                number, state = held[0]["_range"], sent.value[held[0]["_range"]]
            state = fold.read(state, [r["_t"] for r in held], [r["_mark"] for r in held])[1]
        yield number, state

    while len(behind) < len(rows):
        unknown: dict[int, Any] = {}
        for k, r in enumerate(rows):
            if r.number in behind or (goes_on[k] and rows[k - 1].number not in behind):
                continue
            state = behind[rows[k - 1].number] if goes_on[k] else fold.fresh
            if said[r.number] is not None:
                behind[r.number] = fold.behind(said[r.number], state)
            else:
                unknown[r.number] = state
        if unknown:
            sent = context.broadcast(unknown)
            behind.update(dict(context.runJob(dealt.select(*columns).rdd, ahead, list(unknown))))
    return {r.number: (r.first, behind[rows[k - 1].number]) for k, r in enumerate(rows) if goes_on[k]}


def scan(rows: DataFrame, subject: str, ts: str, order: list[str], fold: Fold, result: str, mark: str | None = None, ranges: int | None = None) -> DataFrame:
    """All rows and columns with ``value``, of type ``result``: what ``fold`` gives for each, read by ``subject`` in order
    of ``ts`` and ``order``."""
    marked = F.expr(mark).cast("boolean") if mark else F.lit(None).cast("boolean")
    columns = [f"c{k}" for k in range(len(rows.columns))]
    inner = rows.select(*[F.col(c).alias(n) for c, n in zip(rows.columns, columns, strict=True)], F.col(subject).cast("string").alias("_subject"), micros(F.col(ts)).alias("_t"), marked.alias("_mark"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    by = ["_subject", "_t", *[f"_o{k}" for k in range(len(order))]]
    dealt = settled((inner.repartitionByRange(ranges, *by) if ranges else inner.repartitionByRange(*by)).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id().cast("long")))
    sent = rows.sparkSession.sparkContext.broadcast(_starts(dealt, fold))
    kind = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}[result]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, fold.fresh, False
        for b in batches:
            who, t, m = (b.column(c).to_pylist() for c in ("_subject", "_t", "_mark"))
            out = []
            for i, j in _runs(who):
                if not begun:
                    began = sent.value.get(b.column("_range")[0].as_py())
                    last, state, begun = who[i], began[1] if began else fold.fresh, True
                elif who[i] != last:
                    last, state = who[i], fold.fresh
                given, state = fold.read(state, t[i:j], m[i:j])
                out += given
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(out, kind)], names=[*columns, "value"])

    kinds = ", ".join(f"{c} {inner.schema[c].dataType.simpleString()}" for c in columns)
    return dealt.mapInArrow(run, f"{kinds}, value {result}").toDF(*rows.columns, "value")


def sessions(events: DataFrame, user: str, ts: str, minutes: int = 60, ranges: int | None = None) -> DataFrame:
    """(user, session, start, last, n) of start-anchored sessions."""
    t = events.select(F.col(user).cast("long").alias(user), ts)
    started = scan(t, user, ts, [], Sessions(minutes * 60 * 1_000_000), "long", ranges=ranges)
    held = started.groupBy(user, F.col("value").alias("start")).agg(F.max(micros(F.col(ts))).alias("last"), F.count(F.lit(1)).alias("n"))
    return ranked(held, [user], ["start"]).select(user, "start", "last", "n", (F.col("_i") + 1).alias("session"))


def rate_limit(hits: DataFrame, subject: str, ts: str, order: str, limit: int, seconds: int, ranges: int | None = None) -> DataFrame:
    """Each hit with ``allowed``: fewer than ``limit`` allowed hits within the last ``seconds``; only those count."""
    rows = hits.select(F.col(order).cast("long").alias(order), F.col(subject).cast("long").alias(subject), ts)
    return scan(rows, subject, ts, [order], Limited(limit, seconds * 1_000_000), "boolean", ranges=ranges).select(order, subject, F.col("value").alias("allowed"))


def alert_rule(points: DataFrame, key: str, ts: str, order: str, bad: str, cool_down: int = 300, hourly: int = 5, ranges: int | None = None) -> DataFrame:
    """(order, key, state): for each point raised, suppressed, resolved or quiet."""
    rows = points.select(F.col(order).cast("long").alias(order), F.col(key).cast("long").alias(key), ts, F.expr(bad).alias("_bad"))
    return scan(rows, key, ts, [order], Alerts(cool_down * 1_000_000, hourly), "string", mark="_bad", ranges=ranges).select(order, key, F.col("value").alias("state"))
