"""Columns of two tables in pairs: by name, then by data."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, Window, functions as F

from ..written import settle

KEEP = 4096  # hashes of a sketch: shares are off by under 0.008 in standard error


def norm(name: str) -> str:
    return re.sub("[^0-9a-z]+", "_", name.lstrip("﻿").casefold()).strip("_")


def by_name(left: list[str], right: list[str], least: float = 0.6) -> list[tuple[str, str, float]]:
    """Equal names first, then the most alike, each column once."""
    out, free_l, free_r = [], list(left), list(right)
    for a in left:
        b = next((b for b in free_r if norm(b) == norm(a)), None)
        if b is not None:
            out.append((a, b, 1.0))
            free_l.remove(a)
            free_r.remove(b)
    scored = sorted(((SequenceMatcher(None, norm(a), norm(b)).ratio(), a, b) for a in free_l for b in free_r), key=lambda x: (-x[0], left.index(x[1]), right.index(x[2])))
    for score, a, b in scored:
        if score >= least and a in free_l and b in free_r:
            out.append((a, b, round(score, 4)))
            free_l.remove(a)
            free_r.remove(b)
    return out


def _distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.lower(F.trim(F.col(c).cast("string"))).alias("v")) for c in columns])))
    return settle(long.filter("v <> ''").select("c", F.xxhash64("v").alias("h")).distinct(), "values")


def shared_values(left: DataFrame, right: DataFrame, a: list[str], b: list[str], keep: int = KEEP) -> DataFrame:
    """a, b, a_values, b_values, containment, jaccard for the pairs of columns that share values.

    A column's sketch holds its ``keep`` least hashes, a sample of its different values that every run draws alike.  The
    sketch of the column with fewer values is looked up in all values of the other, so the share it finds is off by
    1 / (2 * sqrt(keep)) at most in standard error, and exact where the column has no more than ``keep`` values."""
    x, y = _distinct(left, a), _distinct(right, b)
    sizes = lambda v, k: v.groupBy(F.col("c").alias(k)).agg(F.count("*").alias(f"{k}_values"))
    least = Window.partitionBy("c").orderBy("h")

    def found(own: DataFrame, k: str, other: DataFrame, o: str) -> DataFrame:
        sketch = own.withColumn("i", F.row_number().over(least)).filter(F.col("i") <= keep)  # cut to keep before the exchange
        met = other.select(F.col("c").alias(o), "h").join(F.broadcast(sketch.select(F.col("c").alias(k), "h")), "h")  # keep rows a column
        return met.groupBy(k, o).agg(F.count("*").alias("met"))

    out = found(x, "a", y, "b").withColumnRenamed("met", "from_a").join(found(y, "b", x, "a").withColumnRenamed("met", "from_b"), ["a", "b"], "full")
    out = out.join(F.broadcast(sizes(x, "a")), "a").join(F.broadcast(sizes(y, "b")), "b")  # a row for each column
    small_a = F.col("a_values") <= F.col("b_values")
    fewer = F.least("a_values", "b_values")
    share = F.coalesce(F.when(small_a, F.col("from_a")).otherwise(F.col("from_b")), F.lit(0)) / F.least(fewer, F.lit(keep))
    out = out.withColumn("containment", share)
    both = F.col("containment") * fewer
    return out.select("a", "b", "a_values", "b_values", "containment", (both / (F.col("a_values") + F.col("b_values") - both)).alias("jaccard"))


def by_data(left: DataFrame, right: DataFrame, a: list[str], b: list[str], least: float = 0.6, keep: int = KEEP) -> list[tuple[str, str, float]]:
    """Pairs of yet unpaired columns by shared values: containment of ``least`` or more, some Jaccard, some name; each
    column once, the best first, ties by name.  Both have two values or more and share two.  The driver sees a row for
    each pair of columns."""
    if not a or not b:
        return []
    scored = []
    for r in shared_values(left, right, a, b, keep).filter((F.col("containment") >= least) & (F.col("containment") * F.least("a_values", "b_values") >= 2)).collect():
        name = SequenceMatcher(None, norm(r["a"]), norm(r["b"])).ratio()
        scored.append((r["containment"] + 0.15 * r["jaccard"] + 0.1 * name, r["a"], r["b"]))
    out, used = [], set()
    for score, p, q in sorted(scored, key=lambda s: (-s[0], s[1], s[2])):
        if ("l", p) not in used and ("r", q) not in used:
            out.append((p, q, round(score, 4)))
            used |= {("l", p), ("r", q)}
    return out


def pair(left: DataFrame, right: DataFrame) -> list[tuple[str, str, float]]:
    named = by_name(left.columns, right.columns)
    rest_l = [c for c in left.columns if c not in {a for a, _, _ in named}]
    rest_r = [c for c in right.columns if c not in {b for _, b, _ in named}]
    return named + by_data(left, right, rest_l, rest_r)
