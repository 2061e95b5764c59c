"""A mapping of two tables' columns as JSON text: which column pairs with which, under which name, by which rule and steps."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, functions as F

from ..functions.values import STEPS, apply_steps
from ..operators.diff import Rule

VERSION = 1


@dataclass(frozen=True)
class Pair:
    """A column of either side under one name; ``left_steps`` and ``right_steps`` are applied before values are compared."""

    left: str
    right: str
    name: str
    rule: Rule = Rule()
    left_steps: tuple = ()
    right_steps: tuple = ()
    key: bool = False


def to_json(pairs: Sequence[Pair]) -> str:
    """Only what differs from the defaults is written."""
    plain = {f.name: f.default for f in fields(Rule)}
    rule = lambda r: {k: v for k, v in asdict(r).items() if v != plain[k]}
    rows = [{"left": p.left, "right": p.right, "name": p.name} | ({"rule": rule(p.rule)} if rule(p.rule) else {}) | {k: v for k in ("left_steps", "right_steps", "key") if (v := getattr(p, k))} for p in pairs]
    return json.dumps({"version": VERSION, "columns": rows}, indent=1)


def from_json(text: str, left: Sequence[str], right: Sequence[str]) -> tuple[list[Pair], list[str]]:
    """The pairs whose columns both tables have, and a sentence for each that was left out.  Steps, rules and names that
    can't be read refuse the whole mapping."""
    found = json.loads(text)
    if not isinstance(found, dict) or found.get("version") != VERSION or not isinstance(found.get("columns"), list):
        raise ValueError(f"no column mapping of version {VERSION}")
    pairs, said, names = [], [], set()
    for row in found["columns"]:
        steps = {k: tuple(tuple(s) if isinstance(s, list) else (s,) for s in row.get(k, ())) for k in ("left_steps", "right_steps")}
        for step in (*steps["left_steps"], *steps["right_steps"]):
            if step[0] not in STEPS:
                raise ValueError(f"{row.get('name')}: there is no step {step[0]!r}")
        if unknown := set(row.get("rule", {})) - {f.name for f in fields(Rule)}:
            raise ValueError(f"{row.get('name')}: a rule has no {', '.join(sorted(unknown))}")
        rule = Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.get("rule", {}).items()})
        name = row.get("name") or row["left"]
        if name.lower() in names:
            raise ValueError(f"two columns are named {name!r}")
        lost = [f"{row[s]!r} is not on the {s} side" for s, have in (("left", left), ("right", right)) if row[s] not in have]
        if lost:
            said.append(f"{name} was left out: {' and '.join(lost)}")
            continue
        names.add(name.lower())
        pairs.append(Pair(row["left"], row["right"], name, rule, **steps, key=bool(row.get("key"))))
    return pairs, said


def apply(left: DataFrame, right: DataFrame, pairs: Sequence[Pair], keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides' paired columns as text under their common names, after their steps."""
    side = lambda df, which: df.select(*keep, *[apply_steps(F.col(f"`{getattr(p, which)}`").cast("string"), getattr(p, f"{which}_steps")).alias(p.name) for p in pairs])
    return side(left, "left"), side(right, "right")


def with_fix(pair: Pair, steps: tuple[tuple, tuple]) -> Pair:
    """A suggested repair (steps of either side) behind the pair's own steps."""
    return Pair(pair.left, pair.right, pair.name, pair.rule, pair.left_steps + tuple(steps[0]), pair.right_steps + tuple(steps[1]), pair.key)
