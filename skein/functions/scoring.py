"""Score formulas of documents and ranked lists as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def length_score(n: Column) -> Column:
    return F.when(n < 500, n / 500).when(n <= 2000, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - (n - 2000) / 10000))


def metadata_quality(fields: list[Column]) -> Column:
    """Share of fields that are present and not blank, zero or false."""
    return reduce(lambda a, b: a + b, [F.coalesce(~c.cast("string").isin("", "0", "0.0", "false"), F.lit(False)).cast("int") for c in fields]) / len(fields)


def age_days(when: Column, as_of: Column) -> Column:
    return F.datediff(as_of, when)


def recency(days: Column) -> Column:
    return F.when(days.isNull(), 0.5).when(days <= 7, 1.0).when(days <= 30, 0.8).when(days <= 90, 0.6).when(days <= 365, 0.4).otherwise(0.2)


def weighted(base: Column, length: Column, metadata: Column, recent: Column) -> Column:
    return clamp(0.5 * base + 0.1 * length + 0.1 * metadata + 0.2 * recent)


def decayed(base: Column, days: Column, rate: float = 0.1) -> Column:
    return base * F.exp(-rate * days)


def popularity(base: Column, views: Column, likes: Column, shares: Column, comments: Column) -> Column:
    part = lambda c, w: F.least(c / 1000, F.lit(1.0)) * w
    return clamp(0.7 * base + 0.3 * (part(views, 0.3) + part(likes, 0.4) + part(shares, 0.2) + part(comments, 0.1)))


def boosted(base: Column, boosts: list[tuple[Column, float]]) -> Column:
    return clamp(reduce(lambda a, b: a * b, [F.when(present, factor).otherwise(1.0) for present, factor in boosts], base))


def hybrid(weighted_: Column, decay: Column, popular: Column, metadata: Column) -> Column:
    return 0.4 * weighted_ + 0.2 * decay + 0.2 * popular + 0.2 * metadata


def adaptive_alpha(n_words: Column, alpha: float = 0.7) -> Column:
    return clamp(F.when(n_words <= 3, alpha - 0.2).when(n_words >= 15, alpha + 0.1).otherwise(alpha))


def combined(semantic: Column, metadata: Column, weight: float = 0.2) -> Column:
    return (1 - weight) * semantic + weight * metadata
