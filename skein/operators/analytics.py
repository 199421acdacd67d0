"""Event analytics: engagement, churn, anomalies, tenants, quotas and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(c.cast("timestamp"))


def segment(n_sessions: Column, n_queries: Column) -> Column:
    return F.when((n_sessions > 20) & (n_queries > 100), "power").when((n_sessions > 10) & (n_queries > 50), "regular").when((n_sessions > 5) & (n_queries > 20), "casual").when(n_sessions > 0, "new").otherwise("inactive")


def engagement(per_day: Column) -> Column:
    return F.when(per_day > 10, "high").when(per_day >= 3, "medium").otherwise("low")


def churn_score(idle_days: Column, n_sessions: Column, satisfaction: Column) -> Column:
    return F.when(idle_days > 30, 3).when(idle_days > 14, 2).when(idle_days > 7, 1).otherwise(0) + F.when(n_sessions < 3, 2).when(n_sessions < 10, 1).otherwise(0) + F.when(satisfaction < 0.3, 2).when(satisfaction < 0.6, 1).otherwise(0)


def churn_probability(score: Column) -> Column:
    return F.when(score >= 6, 0.9).when(score >= 4, 0.7).when(score >= 3, 0.5).when(score >= 2, 0.3).otherwise(0.1)


def churn_status(p: Column) -> Column:
    return F.when(p > 0.7, "high").when(p > 0.4, "medium").otherwise("low")


def anomaly(value: Column, mean: Column, std: Column) -> Column:
    """The first that applies, in standard deviations of a sample; one row has deviation 0."""
    far = F.abs(value - mean)
    return F.when((std > 0) & (far > 3 * std), "critical").when((std > 0) & (far > 2 * std), "high").when(value < 0, "high").when(value > 1000, "medium")


def usage_cost(queries: Column, gigabytes: Column, calls: Column, base: Column, digits: int = 2) -> Column:
    return F.round(base + 0.001 * queries + 0.1 * gigabytes + 0.01 * calls, digits)


def health(cpu: Column, memory: Column, errors: Column) -> Column:
    return F.greatest(F.lit(0), 100 - F.when(cpu > 90, 30).when(cpu > 80, 15).otherwise(0) - F.when(memory > 95, 30).when(memory > 85, 15).otherwise(0) - F.when(errors > 0.1, 30).when(errors > 0.05, 15).otherwise(0))


def health_band(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "fair").when(score >= 30, "poor").otherwise("critical")


def capacity_days(used: Column, monthly_growth: float, most: int = 365) -> Column:
    """Days of daily compounding until 90 per cent."""
    days = F.ceil(F.log(90 / used) / F.log(F.lit(1 + monthly_growth / 30)))
    return F.when(used >= 90, 0).otherwise(F.least(days, F.lit(most)))


def eviction_order(how: str, access: Column, age: Column, idle: Column, quality: Column) -> Column:
    """What is evicted first has the smallest value."""
    return {"usage": access / (age + 1), "lru": -idle, "lfu": access, "adaptive": 0.4 * F.least(access / 100, F.lit(1.0)) + 0.3 / (1 + idle) + 0.2 * quality + 0.1 * F.least(access / (age + 1), F.lit(1.0))}[how]


def resized(size: Column, hit_rate: Column, least: int = 500, most: int = 2000) -> Column:
    return F.when(hit_rate < 0.5, F.least((size * 1.2).cast("int"), F.lit(most))).when(hit_rate > 0.9, F.greatest((size * 0.8).cast("int"), F.lit(least))).otherwise(size)


def alerts(points: DataFrame, key: str, ts: str, order: str, bad: Column, seconds: int = 300) -> DataFrame:
    """Bad points, without those within ``seconds`` of the point before of the same key."""
    w = Window.partitionBy(key).orderBy("_t", order)
    t = points.filter(bad).withColumn("_t", micros(F.col(ts)))
    gap = F.col("_t") - F.lag("_t").over(w)
    return t.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") > seconds * 1_000_000)).drop("_t", "_gap")


def histogram(rows: DataFrame, keys: list[Column], value: str, bounds: list[float]) -> DataFrame:
    """Rows by key with ``buckets``, the cumulative counts up to each bound and, last, of all values."""
    upto = [F.sum((F.col(value) <= b).cast("long")) for b in bounds]
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.array(*upto, F.count(F.lit(1))).alias("buckets"))


def histogram_quantile(q: float, buckets: Column, bounds: list[float]) -> Column:
    """The value below which a share q lies, linear within the first bucket that reaches it; the lowest bucket begins at 0
    unless its bound isn't above, and what lies in the open last one is told as the highest bound.  Null without values."""
    total = F.element_at(buckets, -1)
    rank, out = F.lit(q) * total, F.lit(float(bounds[-1]))
    for k in reversed(range(len(bounds))):
        here, before = F.get(buckets, F.lit(k)), F.get(buckets, F.lit(k - 1)) if k else F.lit(0)
        low = bounds[k - 1] if k else 0.0
        inside = low + (bounds[k] - low) * ((rank - before) / F.nullif(here - before, F.lit(0)))
        out = F.when(here >= rank, F.lit(float(bounds[0])) if k == 0 and bounds[0] <= 0 else inside).otherwise(out)
    return F.when(total > 0, out)
