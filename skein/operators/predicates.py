"""One predicate tree, compiled to a Column and to nested where-documents, and read back from these.

A tree is made of :class:`skein.operators.filters.Condition` and :class:`Group`.  A group joins its conditions and its
sub-groups by AND or OR; NOT is what none of them matches.  A document states each comparison as ``{field: {"$op": value}}``
and nests by ``$and``, ``$or`` and ``$not``; a range is two comparisons, a circle on the globe ``$within``.  A field that a
row lacks matches no comparison.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.operators.filters import Condition

#: Operators that a plain where-document may hold.
WHERE = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$contains", "$not_contains")


@dataclass(frozen=True)
class Group:
    """``logic`` is and, or, not."""

    logic: str
    conditions: tuple = ()
    sub_groups: tuple = ()

    def parts(self) -> tuple:
        return (*self.conditions, *self.sub_groups)


def column(tree: Condition | Group) -> Column:
    """The tree as a Column, never null; a group without parts matches all (or: none)."""
    if isinstance(tree, Condition):
        return F.coalesce(tree.column(), F.lit(False))
    columns = [column(p) for p in tree.parts()]
    if tree.logic == "and":
        return reduce(lambda a, b: a & b, columns, F.lit(True))
    either = reduce(lambda a, b: a | b, columns, F.lit(False))
    return ~either if tree.logic == "not" else either


def document(tree: Condition | Group) -> dict[str, Any]:
    """The tree as a where-document."""
    if isinstance(tree, Group):
        return {f"${tree.logic}": [document(p) for p in tree.parts()]}
    if tree.op == "range":
        low, high, *inclusive = tree.value
        above, below = ("$gte", "$lte") if not inclusive or inclusive[0] else ("$gt", "$lt")
        return {"$and": [{tree.field: {above: low}}, {tree.field: {below: high}}]}
    if tree.op == "geo":
        lat, lon, km = tree.value
        return {tree.field: {"$within": {"lat": lat, "lon": lon, "km": km}}}
    if tree.op == "regex":
        return {tree.field: {"$regex": tree.value, "$options": "i" if tree.ignore_case else ""}}
    return {tree.field: {f"${tree.op}": list(tree.value) if tree.op in ("in", "nin") else tree.value}}


def read(spec: dict[str, Any]) -> Condition | Group:
    """The tree of a where-document; ValueError for an operator that isn't known."""
    found: list[Condition | Group] = []
    for key, value in spec.items():
        if key in ("$and", "$or", "$not"):
            parts = tuple(read(s) for s in value)
            found.append(Group(key[1:], tuple(p for p in parts if isinstance(p, Condition)), tuple(p for p in parts if isinstance(p, Group))))
        elif not isinstance(value, dict):
            found.append(Condition(key, "in", tuple(value)) if isinstance(value, list) else Condition(key, "eq", value))
        else:
            found += [_one(key, op, v, value) for op, v in value.items() if op != "$options"]
    return found[0] if len(found) == 1 else Group("and", tuple(p for p in found if isinstance(p, Condition)), tuple(p for p in found if isinstance(p, Group)))


def _one(field: str, op: str, value: Any, whole: dict) -> Condition | Group:
    if op == "$within":
        return Condition(field, "geo", (value["lat"], value["lon"], value["km"]))
    if op == "$regex":
        return Condition(field, "regex", value, ignore_case="i" in whole.get("$options", ""))
    if op == "$not_contains":
        # A field that is missing doesn't match this either.
        return Group("and", (Condition(field, "exists", True),), (Group("not", (Condition(field, "contains", value),)),))
    if op[1:] not in ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "contains", "exists"):
        raise ValueError(f"unknown operator {op}")
    return Condition(field, op[1:], tuple(value) if op in ("$in", "$nin") else value)


def where(spec: dict[str, Any] | None) -> dict[str, Any]:
    """A loose filter as a where-document of one key: a list is ``$in``, a value ``$eq``, several fields an ``$and``;
    operators that such a document may not hold go, and with them a field that has no other."""
    if not spec or "$and" in spec or "$or" in spec:
        return spec or {}
    found: dict[str, Any] = {}
    for field, value in spec.items():
        if isinstance(value, dict):
            kept = {op: v for op, v in value.items() if op in WHERE}
            if kept or "$and" in value or "$or" in value:
                found[field] = kept or value
        else:
            found[field] = {"$in": value} if isinstance(value, list) else {"$eq": value}
    return {"$and": [{f: v} for f, v in found.items()]} if len(found) > 1 else found


def matching(spec: dict[str, Any] | None) -> Column:
    """The rows that a loose filter means."""
    said = where(spec)
    return column(read(said)) if said else F.lit(True)
