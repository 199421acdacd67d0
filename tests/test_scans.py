"""Ordered folds dealt by ranges against the same folds read at once."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import scans

START = datetime(2024, 1, 1)


def test_alert_rule_by_hand(spark):
    start = datetime(2024, 1, 1)
    steps = [(0, True), (10, True), (20, False), (30, True), (400, True), (410, False), (420, False)]
    rows = [(i, 1, start + timedelta(seconds=s), bad) for i, (s, bad) in enumerate(steps)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp, bad boolean")
    got = {r.id: r.state for r in scans.alert_rule(df, "k", "ts", "id", "bad").collect()}
    assert [got[i] for i in range(len(steps))] == ["raised", "suppressed", "resolved", "suppressed", "raised", "resolved", "quiet"]


def test_rate_limit_by_hand(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, 1, start + timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 9, 10, 11, 12])]
    got = {r.event_id: r.allowed for r in scans.rate_limit(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), "user_id", "ts", "event_id", 3, 10).collect()}
    # A hit exactly one window old has expired; rejected hits are not recorded.
    assert [got[i] for i in range(7)] == [True, True, True, False, True, True, True]


def events(spark, seed, n=1500):
    """A hot subject with half of the rows, in bursts and pauses, others, and one without a name."""
    draw = random.Random(seed)
    at, rows = dict.fromkeys((1, 2, 3, None), 0.0), []
    for i in range(n):
        who = 1 if draw.random() < 0.5 else draw.choice([2, 3, None])
        at[who] += draw.choice([0, 0.5, 1, 1, 2, 5, 5, 30 if who == 1 else 400])
        rows.append((i, who, START + timedelta(seconds=at[who]), draw.random() < 0.3))
    return rows, spark.createDataFrame(rows, "id long, k long, ts timestamp, bad boolean")


def by_subject(rows):
    found = {}
    for i, k, ts, bad in sorted(rows, key=lambda r: (r[2], r[0])):
        found.setdefault(k, []).append((i, (ts - START).total_seconds(), bad))
    return found


def plain_sessions(rows, limit):
    out = set()
    for k, held in by_subject(rows).items():
        found = []
        for _, t, _ in held:
            if not found or t - found[-1][0] > limit:
                found.append([t, t, 0])
            found[-1][1:] = t, found[-1][2] + 1
        out |= {(k, s + 1, *x) for s, x in enumerate(found)}
    return out


def plain_limit(rows, limit, window):
    out = {}
    for held in by_subject(rows).values():
        log = deque()
        for i, t, _ in held:
            while log and log[0] <= t - window:
                log.popleft()
            out[i] = len(log) < limit
            if out[i]:
                log.append(t)
    return out


def plain_alerts(rows, cool_down, hourly):
    out = {}
    for held in by_subject(rows).values():
        active, raised = False, []
        for i, t, bad in held:
            raised = [x for x in raised if x > t - 3600]
            if not bad:
                out[i], active = "resolved" if active else "quiet", False
            elif active or len(raised) >= hourly or (raised and t - raised[-1] < cool_down):
                out[i] = "suppressed"
            else:
                out[i], active = "raised", True
                raised.append(t)
    return out


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_sessions_in_ranges(spark, ranges):
    for seed, minutes in ((1, 1), (2, 5)):
        rows, df = events(spark, seed)
        begin = F.unix_micros(F.lit(START).cast("timestamp"))
        got = {(r.k, r.session, r.a, r.b, r.n) for r in scans.sessions(df, "k", "ts", minutes, ranges).select("k", "session", ((F.col("start") - begin) / 1e6).alias("a"), ((F.col("last") - begin) / 1e6).alias("b"), "n").collect()}
        assert got == plain_sessions(rows, minutes * 60)


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_limits_in_ranges(spark, ranges):
    # The first never lets a range know its end, the second mostly does.
    for seed, limit, seconds in ((3, 4, 600), (4, 3, 8)):
        rows, df = events(spark, seed)
        assert {r.id: r.allowed for r in scans.rate_limit(df, "k", "ts", "id", limit, seconds, ranges).collect()} == plain_limit(rows, limit, seconds)


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_alerts_in_ranges(spark, ranges):
    rows, df = events(spark, 5)
    assert {r.id: r.state for r in scans.alert_rule(df, "k", "ts", "id", "bad", 30, 4, ranges).collect()} == plain_alerts(rows, 30, 4)


def test_no_task_reads_a_hot_subject_alone(spark):
    hot = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    sizes = [r.n for r in scans.scan(hot, "k", "ts", ["id"], scans.Limited(5, 60_000_000), "boolean", ranges=16).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 16 and max(sizes) <= 2 * sorted(sizes)[8]


def test_empty_events(spark):
    none = events(spark, 1, 3)[1].limit(0)
    assert scans.sessions(none, "k", "ts").count() == scans.rate_limit(none, "k", "ts", "id", 3, 5).count() == scans.alert_rule(none, "k", "ts", "id", "bad").count() == 0


@pytest.mark.parametrize("ranges", [1, 9, 40])
def test_two_levels_in_ranges(spark, ranges):
    rows, df = events(spark, 6)
    want = {}
    for held in by_subject(rows).values():
        got = made = None
        for i, t, mark in held:
            alive = made is not None and (t - got <= 20 or t - made <= 90)
            if mark:
                want[i], made = ("gone" if alive else "nothing"), None
            elif alive and t - got <= 20:
                want[i] = "first"
            elif alive:
                want[i], got = "second", t
            else:
                want[i], got, made = "miss", t, t
    told = scans.scan(df, "k", "ts", ["id"], scans.TwoLevels(20_000_000, 90_000_000), "string", mark="bad", ranges=ranges)
    assert {r.id: r.value for r in told.collect()} == want
