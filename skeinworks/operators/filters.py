"""Filter algebra: conditions are validated when the plan is built and become native Columns.

A group is a conjunction, a list of groups a disjunction. Comparisons are null-safe: a null field passes
`not_equals` and `not_in`, and fails every other condition. Plain comparisons stay plain (null, which a
filter drops like false), so that they reach the scan; only what is denied is made null-safe. Fields inside `breadcrumbs` match if any element does.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Filterable fields and their kinds.
FIELDS = {
    "entity_id": "text",
    "name": "text",
    "created_at": "date",
    "updated_at": "date",
    "breadcrumbs.entity_id": "text",
    "breadcrumbs.name": "text",
    "breadcrumbs.entity_type": "text",
    "entity_type": "text",
    "source_name": "text",
    "original_entity_id": "text",
    "chunk_index": "number",
    "sync_id": "text",
    "sync_job_id": "text",
}
ORDERING = {"greater_than": "__gt__", "less_than": "__lt__", "greater_than_or_equal": "__ge__", "less_than_or_equal": "__le__"}
OPERATORS = ["equals", "not_equals", "contains", *ORDERING, "in", "not_in"]


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Any


Group = Sequence[Condition]


def epoch_seconds(value: str) -> int:
    """Seconds of an ISO date; quotes are dropped, a missing zone is UTC."""
    text = value.strip().strip("'\"").replace("Z", "+00:00")
    when = datetime.fromisoformat(text)
    if when.tzinfo is None:
        when = datetime.fromisoformat(text + "+00:00" if "T" in text or " " in text else text + "T00:00:00+00:00")
    return int(when.timestamp())


def normalize(c: Condition) -> Condition:
    """A lone string given to a list operator becomes a list; an empty one becomes an empty list."""
    if c.operator in ("in", "not_in") and isinstance(c.value, str):
        text = c.value.strip()
        if text.startswith("["):
            return Condition(c.field, c.operator, json.loads(text))
        return Condition(c.field, c.operator, [c.value] if text else [])
    return c


def validate(c: Condition) -> None:
    """Raise ValueError for a condition that has no meaning."""
    kind = FIELDS.get(c.field)
    if kind is None:
        raise ValueError(f"unknown field {c.field}")
    if c.operator not in OPERATORS:
        raise ValueError(f"unknown operator {c.operator}")
    if c.operator in ("in", "not_in"):
        if not isinstance(c.value, (list, tuple)):
            raise ValueError(f"{c.operator} needs a list")
        return
    if isinstance(c.value, (list, tuple)):
        raise ValueError(f"{c.operator} takes one value")
    if c.operator == "contains" and kind != "text":
        raise ValueError("contains is for text fields")
    if c.operator in ORDERING and kind == "text":
        raise ValueError(f"{c.operator} is for dates and numbers")
    if kind == "number":
        int(c.value)
    if kind == "date" and isinstance(c.value, str):
        epoch_seconds(c.value)


def _literal(kind: str, value: Any) -> Any:
    if kind == "date":
        return epoch_seconds(value) if isinstance(value, str) else int(value)
    return int(value) if kind == "number" else str(value)


def _test(column: Column, kind: str, operator: str, value: Any) -> Column:
    if operator in ("in", "not_in"):
        hit = column.isin([_literal(kind, v) for v in value]) if value else F.lit(False)
        return ~F.coalesce(hit, F.lit(False)) if operator == "not_in" else hit
    literal = F.lit(_literal(kind, value))
    if operator == "equals":
        return column.eqNullSafe(literal)
    if operator == "not_equals":
        return ~column.eqNullSafe(literal)
    if operator == "contains":
        return F.lower(column).contains(F.lower(literal))
    return getattr(column, ORDERING[operator])(literal)


def condition(c: Condition) -> Column:
    c = normalize(c)
    validate(c)
    kind = FIELDS[c.field]
    outer, _, inner = c.field.partition(".")
    if not inner:
        return _test(F.col(outer), kind, c.operator, c.value)
    positive = {"not_equals": "equals", "not_in": "in"}.get(c.operator, c.operator)
    hit = F.coalesce(F.exists(outer, lambda b: _test(b[inner], kind, positive, c.value)), F.lit(False))
    return ~hit if positive != c.operator else hit


def all_of(columns: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, columns, F.lit(True))


def any_of(columns: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, columns, F.lit(False))


def groups(found: Sequence[Group]) -> Column:
    """Groups or-ed, conditions inside and-ed; no group means no restriction."""
    return any_of([all_of([condition(c) for c in g]) for g in found]) if found else F.lit(True)


def merged(user: Sequence[Group], plan: Sequence[Group], merge: str = "flat") -> list[list[Condition]]:
    """User groups with a plan's. "flat": all user conditions are added to each plan group; "dnf" keeps their `or`."""
    if not user or not plan:
        return [list(g) for g in (plan or user)] if merge == "dnf" or plan else ([[c for g in user for c in g]] if user else [])
    if merge == "flat":
        extra = [c for g in user for c in g]
        return [[*g, *extra] for g in plan]
    return [[*p, *u] for p in plan for u in user]


def name_contains(text: str) -> Column:
    return F.lower("name").contains(text.lower())


def tenant(collection_id: str) -> Column:
    return F.col("collection_id") == collection_id
