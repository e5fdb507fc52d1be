"""Row predicates as boolean columns. All are two-valued: a predicate on NULL is true or false, never NULL."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions import jsonpath
from veilwork.plans.policy import Predicate, RowFilter, When, split_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\z"
EPSILON = 2.220446049250313e-16


def text_of(value) -> str | None:
    """A policy's scalar as the text cells are compared with; None for what never matches."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return json.dumps(value)
    return value if isinstance(value, str) else None


def like_pattern(pattern: str) -> str:
    """A LIKE pattern as a regular expression: no escape character, ``_`` and ``%`` don't match a line break."""
    return "^(?:" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern) + r")\z"


def java_pattern(pattern: str) -> str:
    """A pattern with ``$`` for the very end, as an unescaped ``$`` outside a class also matches before a last line break in Java."""
    out, escaped, depth = [], False, 0
    for c in pattern:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == "[":
            depth += 1
        elif c == "]" and depth:
            depth -= 1
        elif c == "$" and not depth:
            out.append(r"\z")
            continue
        out.append(c)
    return "".join(out)


def _folded(c: Column, insensitive: bool) -> Column:
    return F.translate(c, UPPER, LOWER) if insensitive else c


def number_of(c: Column) -> Column:
    """A cell as a double if it is written as a plain number, without blanks or suffixes; else NULL."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def _one(p: Predicate, c: Column) -> Column:
    """The predicate on one text, NULL where the text is."""
    if p.op in ("eq", "neq"):
        value = text_of(p.value)
        return F.lit(False) if value is None else _folded(c, p.case_insensitive) == (_fold(value) if p.case_insensitive else value)
    if p.op in ("in", "not_in"):
        values = [v for v in map(text_of, p.values or ()) if v is not None]
        return _folded(c, p.case_insensitive).isin([_fold(v) for v in values] if p.case_insensitive else values) if values else F.lit(False)
    if p.op in ("like", "ilike"):
        value = text_of(p.value)
        insensitive = p.op == "ilike" or p.case_insensitive
        return F.lit(False) if value is None else c.rlike(("(?iu)" if insensitive else "") + like_pattern(value))
    if p.op in ("regex", "iregex"):
        value = text_of(p.value)
        insensitive = p.op == "iregex" or p.case_insensitive
        return F.lit(False) if value is None else c.rlike(("(?iU)" if insensitive else "(?U)") + java_pattern(value))
    value = text_of(p.value)
    if value is None or not re.match(NUMBER.replace(r"\z", r"\Z"), value):
        return F.lit(False)
    right, left = float(value), number_of(c)
    if right != right:  # nothing is ordered before or equal to a value that is no number
        return left.isNotNull() & F.lit(p.op in ("gt", "gte"))
    near = F.abs(left - F.lit(right)) < EPSILON if abs(right) != float("inf") else left == F.lit(right)
    less = (left < F.lit(right)) & ~near
    return {"lt": less, "lte": less | near, "gt": ~less & ~near, "gte": ~less}[p.op]


def _fold(value: str) -> str:
    return value.translate(str.maketrans(UPPER, LOWER))


def predicate(p: Predicate, columns: Sequence[str], *, strict: bool = True) -> Column:
    """The predicate over a row of the named columns. A column that isn't there makes it false, whatever the operator.
    Unless ``strict``, it may be NULL instead of false, which lets a filter reach the scan."""
    by_name = {c.lower(): c for c in columns}
    name, path = (p.column, ()) if p.column.lower() in by_name else split_key(p.column)
    if name.lower() not in by_name:
        return F.lit(False)
    cell = F.col(f"`{by_name[name.lower()]}`").cast("string")
    if not path:
        if p.op == "is_null":
            return cell.isNull()
        if p.op == "not_null":
            return cell.isNotNull()
        found = _one(p, cell)
        if not strict and p.op not in ("neq", "not_in"):
            return found
        found = F.coalesce(found, F.lit(False))
        return ~found if p.op in ("neq", "not_in") else found
    targets = jsonpath.read(cell, path)
    if p.op == "is_null":
        return F.forall(targets, lambda t: t.isNull())
    if p.op == "not_null":
        return F.exists(targets, lambda t: t.isNotNull())
    found = F.exists(targets, lambda t: F.coalesce(_one(p, t), F.lit(False)))
    return ~found if p.op in ("neq", "not_in") else found


def _any(ps: Sequence[Predicate], columns: Sequence[str], strict: bool = True) -> Column:
    return reduce(lambda a, b: a | b, (predicate(p, columns, strict=strict) for p in ps))


def keep_row(f: RowFilter | None, columns: Sequence[str], *, strict: bool = True) -> Column | None:
    """Whether a row stays: some ``retain`` matches, if there are any, and no ``delete`` does. None if all rows stay.
    Unless ``strict``, NULL stands for no, as in a WHERE."""
    if f is None or not (f.retain or f.delete):
        return None
    parts = []
    if f.retain:
        parts.append(_any(f.retain, columns, strict))
    if f.delete:
        parts.append(~_any(f.delete, columns))
    return reduce(lambda a, b: a & b, parts)


def holds(w: When, columns: Sequence[str]) -> Column:
    parts = [predicate(p, columns) for p in w.all]
    if w.any:
        parts.append(_any(w.any, columns))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
