"""Filters: a compact grammar, typed operands, and the two rules for null rows under "not" operators.

A filter on both sides keeps null rows under !=, not in and not like; a filter on one side drops them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F

from . import dates
from .values import to_double

NEGATIVE = {"ne", "not_in", "not_like"}
_OPS = [
    (r"is\s+not\s+null", "not_null"), (r"is\s+null", "is_null"), (r"not\s+in", "not_in"), (r"in", "in"), (r"not\s+like", "not_like"), (r"ilike", "ilike"), (r"like", "like"),
    (r"between", "between"), (r"!=|<>", "ne"), (r">=", "ge"), (r"<=", "le"), (r"==?", "eq"), (r">", "gt"), (r"<", "lt"), (r"~", "regex"),
]


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None
    kind: str = "text"


def _literal(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def parse(text: str) -> Filter:
    """``col[:kind] op value``, e.g. ``amount:number between 1..5``, ``state not in (a, b)``, ``name ~ ^x``."""
    m = re.match(r"\s*(?:\"([^\"]+)\"|([^\s:!<>=~]+))(?::(\w+))?\s*(.*)$", text, re.S)
    if not m:
        raise ValueError(f"no filter: {text!r}")
    column, kind, rest = m[1] or m[2], m[3] or "text", m[4]
    for pattern, op in _OPS:
        found = re.match(pattern + (r"\b" if pattern[-1].isalpha() else ""), rest, re.I)
        if not found:
            continue
        value = rest[found.end() :].strip()
        if op in ("is_null", "not_null"):
            return Filter(column, op, None, kind)
        if not value:
            raise ValueError(f"a value is missing: {text!r}")
        if op in ("in", "not_in"):
            return Filter(column, op, tuple(_literal(v) for v in value.strip("()").split(",")), kind)
        if op == "between":
            ends = re.split(r"\.\.|\s+and\s+", value, flags=re.I)
            if len(ends) != 2:
                raise ValueError(f"between takes two values: {text!r}")
            return Filter(column, op, tuple(map(_literal, ends)), kind)
        return Filter(column, op, _literal(value), kind)
    raise ValueError(f"no operator: {text!r}")


def _typed(x: Column, kind: str, formats: Sequence[str] = ()) -> Column:
    if kind == "number":
        return to_double(x)
    if kind in ("date", "timestamp"):
        stamp = dates.to_stamp(x, list(formats) or None)
        return stamp.cast("date") if kind == "date" else stamp
    return x


def _number(text: str, column: str) -> Column:
    if not re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", text):
        raise ValueError(f"the filter on {column} needs a number, and {text!r} is none")
    return to_double(F.lit(text.strip()))


def compile(f: Filter, null_keeping: bool = True, formats: dict[str, Sequence[str]] | None = None) -> Column:
    """The filter as a column.  ``null_keeping``: whether null rows pass the negative operators.  ``formats``: by column,
    the formats in which its dates are written; those of the filter's values are read as any date is.  A value that
    is no number is refused where the filter's kind is number."""
    x = F.col(f.column).cast("string")
    if f.op == "is_null":
        return x.isNull()
    if f.op == "not_null":
        return x.isNotNull()
    if f.op in ("like", "not_like", "ilike", "regex"):
        hit = {"like": x.like, "not_like": x.like, "ilike": x.ilike, "regex": x.rlike}[f.op](f.value)
        got = ~hit if f.op == "not_like" else hit
    else:
        left = _typed(x, f.kind, (formats or {}).get(f.column, ()))
        value = lambda v: _number(str(v), f.column) if f.kind == "number" else _typed(F.lit(str(v)), f.kind)
        if f.op in ("in", "not_in"):
            hit = left.isin(*[value(v) for v in f.value])
            got = ~hit if f.op == "not_in" else hit
        elif f.op == "between":
            got = left.between(value(f.value[0]), value(f.value[1]))
        else:
            right = value(f.value)
            got = {"eq": left == right, "ne": left != right, "gt": left > right, "ge": left >= right, "lt": left < right, "le": left <= right}[f.op]
    return got | x.isNull() if f.op in NEGATIVE and null_keeping else got


def every(filters: list[Filter], null_keeping: bool = True, formats: dict[str, Sequence[str]] | None = None) -> Column:
    out = F.lit(True)
    for f in filters:
        out = out & compile(f, null_keeping, formats)
    return out


def quick(column: str, op: str, value: Any = None) -> Column:
    """The row picker's clauses: contains and starts with ignore case; numbers compare as numbers."""
    x = F.col(column).cast("string")
    if op in ("contains", "starts with"):
        low = str(value).lower()
        return F.lower(x).contains(low) if op == "contains" else F.lower(x).startswith(low)
    if op == "in":
        return x.isin([str(v) for v in value])
    if op in ("is null", "is not null"):
        return x.isNull() if op == "is null" else x.isNotNull()
    number = re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", str(value)) is not None
    names = {"=": "eq", "!=": "ne", ">": "gt", ">=": "ge", "<": "lt", "<=": "le"}
    return compile(Filter(column, names[op], value, "number" if number else "text"), null_keeping=False)
