"""A small language of metadata predicates, compiled to column expressions.

``{"a": 1}`` and ``{"a": {"$eq": 1}}`` compare; ``$ne``, ``$in``, ``$nin``, ``$and`` and ``$or`` as their names say. A missing value is a
value of its own: it equals only itself, and isn't in any list. An operator that isn't known lets nothing through; with ``strict`` it raises.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def compiled(where: dict[str, Any] | None, strict: bool = False, column=F.col) -> Column:
    """``column`` gives the column of a field's name."""
    if not where:
        return F.lit(True)
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            inner = [compiled(w, strict, column) for w in value]
            out = inner[0] if inner else F.lit(key == "$and")
            for x in inner[1:]:
                out = out & x if key == "$and" else out | x
            parts.append(out)
        elif key.startswith("$"):
            parts.append(_unknown(key, strict))
        elif isinstance(value, dict):
            parts += [_compare(column(key), op, v, strict) for op, v in value.items()]
        else:
            parts.append(column(key).eqNullSafe(value))
    out = parts[0]
    for x in parts[1:]:
        out = out & x
    return out


def _unknown(op: str, strict: bool) -> Column:
    if strict:
        raise ValueError(f"unknown operator {op}")
    return F.lit(False)


def _compare(c: Column, op: str, value: Any, strict: bool) -> Column:
    if op == "$eq":
        return c.eqNullSafe(value)
    if op == "$ne":
        return ~c.eqNullSafe(value)
    if op == "$in":
        return F.coalesce(c.isin(list(value)), F.lit(False)) if value else F.lit(False)
    if op == "$nin":
        return F.coalesce(~c.isin(list(value)), F.lit(True)) if value else F.lit(True)
    return _unknown(op, strict)


def visible(groups: list[str] | None = None, extra: dict[str, Any] | None = None) -> Column:
    """Active rows that one of ``groups`` may see (everybody's are marked *), and ``extra`` besides."""
    where: list[dict[str, Any]] = [{"doc_status": "active"}]
    if groups is not None:
        where.append({"acl": {"$in": groups}})
    return compiled({"$and": where + ([extra] if extra else [])})
