"""A comparison worked out from two tables alone: pairs of columns, kinds, key, then the comparison itself."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, functions as F

from ..functions.values import ColSpec, canonicalise
from . import diff, keys, match, pairing, readback, sniff

DATE_NAME = "date|day|time|stamp|_dt$|_at$|^dt_|period|month|year"  # a fixed value: names that speak of a date


@dataclass(frozen=True)
class Reading:
    """How both sides of a column are read: its kind, and by side the formats tried first and the steps done before."""

    kind: str = "text"
    formats: tuple[tuple, tuple] = ((), ())
    steps: tuple[tuple, tuple] = ((), ())
    note: str = ""


@dataclass
class Plan:
    pairs: list[tuple[str, str, float]]
    kinds: dict[str, str]
    key: tuple[str, ...]
    notes: list[str]
    folded: tuple[str, ...] = ()  # text columns that agree in upper case alone
    readings: dict[str, Reading] = field(default_factory=dict)


def decide(name: str, left: Row | None, right: Row | None) -> Reading:
    """The reading of a column from the counts of :func:`sniff.spellings` on either side; both sides must agree in 98 %.

    Booleans come first, then dates, unless the values are numbers and the name doesn't speak of a date, then numbers.  A
    side's order of day and month is taken from all its values; where both orders read them, the day is put first."""
    sides = [left, right]
    if any(r is None or not r["filled"] for r in sides):
        return Reading(note=f"{name} is empty on a side, so it is text")
    reads = lambda r, kind: r[kind] >= sniff.SHARE * r["filled"]
    both = lambda kind: all(reads(r, kind) for r in sides)
    if both("booleans") and not both("numbers"):
        return Reading("boolean", note=f"{name} reads as boolean")
    if both("stamps") and (not both("grouped") or re.search(DATE_NAME, name, re.I)):
        orders = [[f for f, kind in ((sniff.DAY_FIRST, "day_first"), (sniff.MONTH_FIRST, "month_first")) if reads(r, kind)] if not reads(r, "iso") else [] for r in sides]
        kind = "timestamp" if any(r["with_time"] for r in sides) else "date"
        unclear = [side for side, order in zip(("left", "right"), orders) if len(order) > 1]
        return Reading(kind, tuple(tuple(o[:1]) for o in orders), note=f"{name} reads as {kind}" + "".join(f"; {side}: day or month may come first, day taken" for side in unclear))
    if both("grouped"):
        steps = tuple(() if reads(r, "numbers") else (("remove_thousands",),) for r in sides)
        return Reading("number", steps=steps, note=f"{name} reads as number" + (", without thousands separators" if any(steps) else ""))
    alone = [side for side, r in zip(("left", "right"), sides) if reads(r, "numbers") or reads(r, "stamps")]
    return Reading(note=f"{name} is text: only the {alone[0]} side converts" if len(alone) == 1 else "")


def plan(left: DataFrame, right: DataFrame) -> Plan:
    pairs = pairing.pair(left, right)
    counted = lambda df, columns: {r["column_name"]: r for r in sniff.spellings(df, columns).collect()} if columns else {}
    a, b = counted(left, [p for p, _, _ in pairs]), counted(right, [q for _, q, _ in pairs])  # a row a column
    readings = {p: decide(p, a.get(p), b.get(q)) for p, q, _ in pairs}
    kinds = {p: r.kind for p, r in readings.items()}
    l, r = sides(left, right, pairs, kinds, readings)
    text = [p for p, _, _ in pairs if kinds[p] == "text"]
    folded = tuple(sorted(x["column_name"] for x in readback.case_probe(l, r, text).filter("ignore_case").collect())) if text else ()  # a row a column
    l, r = fold(l, folded), fold(r, folded)
    found = keys.search_pair(l, r, [p for p, _, _ in pairs])
    notes = [r.note for r in readings.values() if r.note]
    notes += [f"{p} agrees in upper case" for p in folded]
    return Plan(pairs, kinds, found[0].columns if found else (), notes, folded, readings)


def fold(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.upper(c) for c in columns}) if columns else df


def sides(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str, float]], kinds: dict[str, str], readings: dict[str, Reading] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides as canonical text under the left side's names."""

    def spec(i: int, name: str, source: str) -> ColSpec:
        reading = (readings or {}).get(name, Reading())
        return ColSpec(name, source, kinds.get(name, "text"), reading.steps[i], reading.formats[i])

    return canonicalise(left, [spec(0, p, p) for p, _, _ in pairs]), canonicalise(right, [spec(1, p, q) for p, q, _ in pairs])


def compare(left: DataFrame, right: DataFrame, made: Plan | None = None) -> tuple[Plan, DataFrame]:
    """The plan and the matched rows; without a key, rows are matched as a whole (every column is the key)."""
    made = made or plan(left, right)
    l, r = (fold(df, made.folded) for df in sides(left, right, made.pairs, made.kinds, made.readings))
    key = list(made.key or [p for p, _, _ in made.pairs])
    return made, match.keyed(l, r, key, l.columns)


def run(left: DataFrame, right: DataFrame) -> tuple[Plan, DataFrame]:
    made, matched = compare(left, right)
    return made, diff.summary(matched, [p for p, _, _ in made.pairs if p not in made.key])
