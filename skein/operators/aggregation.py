"""Aggregates with the several exact definitions of percentile, variance and mode, and trend windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.store import settled


def summary(value: Column) -> dict[str, Column]:
    """COUNT, SUM, AVG, MIN, MAX, MEDIAN, STD_DEV and VARIANCE; the last two are those of a sample, 0 for one row."""
    v = F.coalesce(value, F.lit(0.0))
    return {"count": F.count(F.lit(1)), "sum": F.sum(v), "avg": F.avg(v), "min": F.min(v), "max": F.max(v), "median": F.median(v), "std": F.coalesce(F.stddev_samp(v), F.lit(0.0)), "var": F.coalesce(F.var_samp(v), F.lit(0.0))}


def rounded(columns: dict[str, Column], digits: int = 4) -> list[Column]:
    return [(c if n in ("count", "n") else F.round(c, digits)).alias(n) for n, c in columns.items()]


def group_key(*fields: str) -> Column:
    """Several fields as one key; a missing one is 'null'."""
    return F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in fields])


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``_i``, their place from 0 by ``order`` among the ``_n`` rows of their key.

    Rows are dealt by ranges of key and order, so a key with a third of all rows is spread like any other.  A row's place
    is its place within its range and the key's rows in the ranges before, of which there is one count for each range
    and key."""
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id())
    # Written down: both uses must see the same ranges, and a lost task must find them again.
    held = settled(dealt).withColumn("_p", F.shiftrightunsigned("_m", 33))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    parts = held.groupBy(F.col("_p").alias("_q"), *named).agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    before = F.coalesce(F.sum("_c").over(own.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_before": before, "_n": F.sum("_c").over(own)})
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return held.join(parts, same).select(*df.columns, (F.col("_m") - F.col("_first") + F.col("_before")).alias("_i"), "_n")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows with ``_total``, the sum of ``value`` over the rows of their key up to them in this order.  Sums run within
    ranges of key and order, and what lay in the ranges before is added, so a key with a third of all rows is spread."""
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id())
    held = settled(dealt).withColumn("_p", F.shiftrightunsigned("_m", 33))
    own = F.sum(value).over(Window.partitionBy("_p", *keys).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    parts = held.groupBy(F.col("_p").alias("_q"), *named).agg(F.sum(value).alias("_part"))
    ahead = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_part").over(ahead), F.lit(0)))
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return held.withColumn("_own", own).join(parts, same).select(*df.columns, (F.col("_own") + F.col("_before")).alias("_total"))


def _ranked(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Values with their rank i from 0 and their number n, by key."""
    values = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    return ranked(values, keys, ["v"]).withColumnsRenamed({"_i": "i", "_n": "n"})


def percentile_index(df: DataFrame, value: str, keys: list[str], percents: list[int]) -> DataFrame:
    """sorted[int(p/100 * (n-1))]."""
    at = lambda p: F.max(F.when(F.col("i") == F.floor(F.lit(p) * (F.col("n") - 1) / 100), F.col("v"))).alias(f"p{p}")
    return _ranked(df, value, keys).groupBy(*keys).agg(*map(at, percents))


def percentile_length(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """sorted[int(n * p)] for p95 and p99, sorted[n // 2] for p50."""
    at = lambda p: F.max(F.when(F.col("i") == F.floor(F.col("n") * p / 100), F.col("v"))).alias(f"p{p}")
    return _ranked(df, value, keys).groupBy(*keys).agg(*map(at, (50, 95, 99)))


def percentile_exclusive(df: DataFrame, value: str, keys: list[str], percents: list[int]) -> DataFrame:
    """Cut points of the exclusive method with 100 parts: linear between neighbours, extended beyond the ends."""
    ranked = _ranked(df, value, keys)

    def cut(p: int) -> Column:
        h = F.lit(p) * (F.col("n") + 1)
        j = F.greatest(F.lit(1), F.least(F.floor(h / 100), F.col("n") - 1))
        low = F.max(F.when(F.col("i") == j - 1, F.col("v")))
        high = F.max(F.when(F.col("i") == j, F.col("v")))
        rest = F.max(h - j * 100)
        return ((low * (100 - rest) + high * rest) / 100).alias(f"p{p}")

    return ranked.groupBy(*keys).agg(*map(cut, percents))


def mode(df: DataFrame, value: str) -> DataFrame:
    """The most frequent value (ties: the smallest), how often it occurs, and how many values there are."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("mode")).agg(F.count(F.lit(1)).alias("frequency"))
    both = counted.agg(F.min(F.struct((-F.col("frequency")).alias("f"), F.col("mode"))).alias("m"), F.count(F.lit(1)).alias("distinct_values"))
    return both.select("m.mode", (-F.col("m.f")).alias("frequency"), "distinct_values")


def windowed(df: DataFrame, ts: str, value: str, keys: list[str], as_of, minutes: int) -> DataFrame:
    """avg, sum, min, max and count of the last minutes before as_of."""
    t = df.filter((F.col(ts) > as_of - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col(ts) <= as_of))
    return t.groupBy(*keys).agg(F.avg(value).alias("avg"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("count"))


def half_split(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Means of the first and of the second half by arrival."""
    r = ranked(df.select(*dict.fromkeys([*keys, *order, value])), keys, order)
    first = F.col("_i") < F.floor(F.col("_n") / 2)
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(first, F.col(value))).alias("first_half"), F.avg(F.when(~first, F.col(value))).alias("second_half"))


def ends(df: DataFrame, keys: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """Means of the first and the last ``size`` rows."""
    r = ranked(df.select(*dict.fromkeys([*keys, *order, value])), keys, order)
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("_i") < size, F.col(value))).alias("first"), F.avg(F.when(F.col("_i") >= F.col("_n") - size, F.col(value))).alias("last"))


def slope(y: str, x: str) -> Column:
    return F.regr_slope(F.col(y), F.col(x))
