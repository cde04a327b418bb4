"""The older filter grammar: nested dicts of must, should and must_not.

must is a conjunction, should a disjunction, both joined by and; must_not denies the conjunction of its
clauses, null counting as false there. A clause that is not understood raises, where a lenient reader would drop it and widen the result.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .filters import all_of, any_of, epoch_seconds

KEYS = {"must", "should", "must_not"}
DATES = {"created_at", "updated_at"}
LISTS = {"access_viewers", "breadcrumbs", "tags"}
_RANGE = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def validate(found: Any) -> None:
    """A filter is a dict of the three keys, each a list of clauses."""
    if not isinstance(found, dict):
        raise ValueError("a filter is a mapping")
    unknown = set(found) - KEYS - {"minimum_should_match"}
    if unknown:
        raise ValueError(f"unknown keys {sorted(unknown)}; conditions belong into must, should or must_not")
    for k in KEYS & set(found):
        if not isinstance(found[k], list):
            raise ValueError(f"{k} is a list")


def _bounds(column: Column, bounds: dict, is_date: bool) -> Column:
    tests = []
    for k, v in bounds.items():
        if k not in _RANGE:
            raise ValueError(f"unknown bound {k}")
        tests.append(getattr(column, _RANGE[k])(F.lit(epoch_seconds(v) if is_date and isinstance(v, str) else v)))
    return all_of(tests)


def _match(key: str, rule: dict) -> Column:
    column, many = F.col(key), key in LISTS
    if "value" in rule:
        hit = F.array_contains(column, rule["value"]) if many else column == F.lit(rule["value"])
        return hit
    for name in ("any", "except"):
        if name in rule:
            values = rule[name]
            if not values:
                return F.lit(name == "except")
            hit = F.arrays_overlap(column, F.array(*map(F.lit, values))) if many else column.isin(values)
            return hit if name == "any" else ~F.coalesce(hit, F.lit(False))
    raise ValueError(f"unknown match {sorted(rule)}")


def _nested(path: str, inner: dict) -> Column:
    """Each condition is tested against any element of its own; must is and, should is or."""

    def one(c: dict) -> Column:
        key, rule = c["key"], c.get("match", {})
        values = [rule["value"]] if "value" in rule else list(rule.get("any", []))
        return F.coalesce(F.exists(path, lambda e: e[key].isin(values)), F.lit(False))

    parts = []
    if inner.get("must"):
        parts.append(all_of([one(c) for c in inner["must"]]))
    if inner.get("should"):
        parts.append(any_of([one(c) for c in inner["should"]]))
    return all_of(parts)


def clause(c: dict) -> Column | None:
    """A Column for one clause; None where the clause asks for nothing."""
    if KEYS & set(c):
        return translate(c)
    if "has_id" in c:
        return F.col("entity_id").isin(c["has_id"]) if c["has_id"] else None
    if "nested" in c:
        return _nested(c["nested"]["key"], c["nested"]["filter"])
    if "is_null" in c:
        rule = c["is_null"] if isinstance(c["is_null"], dict) else {"key": c["key"], "value": c["is_null"]}
        column = F.col(rule["key"])
        return column.isNull() if rule.get("value", True) else column.isNotNull()
    if "is_empty" in c:
        rule = c["is_empty"] if isinstance(c["is_empty"], dict) else {"key": c["key"], "value": c["is_empty"]}
        size = F.coalesce(F.size(rule["key"]), F.lit(0))
        return size == 0 if rule.get("value", True) else size > 0
    if "values_count" in c:
        return _bounds(F.coalesce(F.size(c["key"]), F.lit(0)), c["values_count"], False)
    if "match" in c:
        return _match(c["key"], c["match"])
    if "range" in c:
        return _bounds(F.col(c["key"]), c["range"], c["key"] in DATES)
    raise ValueError(f"unknown clause {sorted(c)}")


def translate(found: dict | None) -> Column:
    """The Column of a filter; an empty one restricts nothing."""
    if not found:
        return F.lit(True)
    validate(found)
    parts = []
    must = [x for x in map(clause, found.get("must", [])) if x is not None]
    should = [x for x in map(clause, found.get("should", [])) if x is not None]
    denied = [x for x in map(clause, found.get("must_not", [])) if x is not None]
    if must:
        parts.append(all_of(must))
    if should:
        least = found.get("minimum_should_match", 1)
        parts.append(any_of(should) if least == 1 else sum((F.when(x, 1).otherwise(0) for x in should), F.lit(0)) >= least)
    if denied:
        parts.append(~F.coalesce(all_of(denied), F.lit(False)))
    return all_of(parts)


def merged(user: dict | None, extracted: dict | None) -> Column:
    """Both filters hold; their `should` lists stay apart, so neither can widen the other."""
    return translate(user) & translate(extracted)


def syncs(ids: list[str] | None) -> Column:
    """Restriction to syncs that were resolved from connections; none resolved means no row."""
    if ids is None:
        return F.lit(True)
    return F.col("sync_id").isin(ids) if ids else F.lit(False)
