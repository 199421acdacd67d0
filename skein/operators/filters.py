"""Typed metadata predicates, compiled to Columns so that Catalyst can push them to the scan.

A missing (null) field matches neither equality nor inequality; every predicate here is null-safe in that sense.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _known(c: Column, test: Column) -> Column:
    return c.isNotNull() & F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class Condition:
    """One comparison: op is eq, ne, gt, gte, lt, lte, in, nin, contains, regex, exists, range or geo."""

    field: str
    op: str
    value: Any = None
    ignore_case: bool = False

    def column(self) -> Column:
        c, v = F.col(self.field), self.value
        plain = {"eq": lambda: c == v, "ne": lambda: c != v, "gt": lambda: c > v, "gte": lambda: c >= v, "lt": lambda: c < v, "lte": lambda: c <= v, "in": lambda: c.isin(*v), "nin": lambda: ~c.isin(*v)}
        if self.op in plain:
            return _known(c, plain[self.op]())
        if self.op == "contains":
            return _known(c, F.contains(c.cast("string"), F.lit(str(v))))
        if self.op == "regex":
            return _known(c, c.cast("string").rlike(("(?i)" if self.ignore_case else "") + v))
        if self.op == "exists":
            return c.isNotNull() if v else c.isNull()
        if self.op == "range":
            return in_range(c, *v)
        if self.op == "geo":
            return within_km(F.col(f"{self.field}.lat"), F.col(f"{self.field}.lon"), *v)
        raise ValueError(f"unknown operator {self.op}")


@dataclass(frozen=True)
class Composite:
    """AND, OR or NOT of conditions and composites; NOT is the complement of its first part alone."""

    op: str
    parts: tuple

    def column(self) -> Column:
        columns = [F.coalesce(p.column(), F.lit(False)) for p in self.parts]
        if self.op == "not":
            return ~columns[0]
        return reduce(lambda a, b: a & b if self.op == "and" else a | b, columns)


def in_range(c: Column, low: Any, high: Any, inclusive: bool = True) -> Column:
    """Between two bounds of one type; what can't be cast to it doesn't match."""
    kind = {int: "bigint", float: "double", str: "string"}[type(low)]
    x = c.try_cast(kind)
    return F.coalesce((x >= low) & (x <= high) if inclusive else (x > low) & (x < high), F.lit(False))


def in_dates(c: Column, first: str, last: str) -> Column:
    """From midnight of the first day to midnight of the last day, so later times of the last day are outside."""
    return F.coalesce((c >= F.lit(first).cast("timestamp")) & (c <= F.lit(last).cast("timestamp")), F.lit(False))


def text_matches(c: Column, text: str, how: str = "contains") -> Column:
    low, want = F.lower(c), F.lit(text.lower())
    return F.coalesce({"contains": F.contains(low, want), "starts": F.startswith(low, want), "ends": F.endswith(low, want), "exact": low == want}[how], F.lit(False))


def near(c: Column, value: float, op: str, tolerance: float) -> Column:
    x = c.try_cast("double")
    test = {"eq": F.abs(x - value) <= tolerance, "ne": F.abs(x - value) > tolerance, "gt": x > value + tolerance, "gte": x >= value - tolerance, "lt": x < value - tolerance, "lte": x <= value + tolerance}[op]
    return F.coalesce(test, F.lit(False))


def array_matches(c: Column, values: list, how: str) -> Column:
    wanted = F.array(*map(F.lit, values))
    test = {"any": F.arrays_overlap(c, wanted), "none": ~F.arrays_overlap(c, wanted), "all": F.size(F.array_except(wanted, c)) == 0}[how]
    return _known(c, test)


def distance_km(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Haversine distance to a point."""
    half_lat, half_lon = F.radians(lat - lat0) / 2, F.radians(lon - lon0) / 2
    a = F.sin(half_lat) ** 2 + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(lat0))) * F.sin(half_lon) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within_km(lat: Column, lon: Column, lat0: float, lon0: float, km: float) -> Column:
    return F.coalesce(distance_km(lat, lon, lat0, lon0) <= km, F.lit(False))


#: What each dialect of document filters understands; unknown operators are ignored, or fail where marked.
DIALECTS = {
    "base": {"$gte", "$lte", "$gt", "$lt", "$in", "$nin"},
    "store": {"$gte", "$lte", "$eq", "$ne"},
    "aggregate": {"$gte", "$lte", "$gt", "$lt", "$eq", "$ne"},
    "where": {"$gte", "$lte", "$gt", "$lt", "$in", "$nin", "$eq", "$ne", "$contains", "$not_contains"},
}


def from_document(spec: dict, dialect: str = "base") -> Column:
    """A filter document such as {"price": {"$gte": 3}, "kind": "a"}; its keys are ANDed, ``$and``/``$or`` nest."""
    known = DIALECTS[dialect]
    tests: list[Column] = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            parts = [from_document(s, dialect) for s in value]
            tests.append(reduce(lambda a, b: a & b if key == "$and" else a | b, parts))
            continue
        c = F.col(key)
        if isinstance(value, dict):
            compare = {"$gte": lambda v: c >= v, "$lte": lambda v: c <= v, "$gt": lambda v: c > v, "$lt": lambda v: c < v, "$eq": lambda v: c == v, "$ne": lambda v: c != v, "$in": lambda v: c.isin(*v), "$nin": lambda v: ~c.isin(*v), "$contains": lambda v: F.contains(c, F.lit(v)), "$not_contains": lambda v: ~F.contains(c, F.lit(v))}
            tests += [_known(c, compare[op](v)) for op, v in value.items() if op in known]
        elif isinstance(value, list):
            tests.append(_known(c, c.isin(*value)))
        else:
            tests.append(_known(c, c == value))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def must(conditions: list[Column], must_not: list[Column] = ()) -> Column:
    return reduce(lambda a, b: a & b, [*conditions, *[~F.coalesce(c, F.lit(False)) for c in must_not]], F.lit(True))


def passes(score: Column, threshold: float) -> Column:
    """Unknown scores pass."""
    return score.isNull() | (score >= threshold)


def passes_if_truthy(score: Column, threshold: float) -> Column:
    """Unknown and zero scores don't pass."""
    return F.coalesce((score != 0) & (score >= threshold), F.lit(False))


RECENT = "(?i)\\b(recent|latest|new|old|today|yesterday)\\b"


def asks_for_recent(question: Column) -> Column:
    return question.rlike("(?i)recent|latest|new|old|today|yesterday")


def tenant_content(text: Column, forbidden: list[str], least: int = 10) -> Column:
    """Long enough, and without any forbidden word."""
    held = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w.lower())) for w in forbidden], F.lit(False))
    return ~held & (F.length(text) >= least)
