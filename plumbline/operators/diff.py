"""Cell differences between matched rows, and the counts of a comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates
from ..functions.values import to_double
from ..written import scratch
from .match import LEFT, OCC, RIGHT

BUCKET = "__bucket__"


@dataclass(frozen=True)
class Rule:
    """How a column's values are held equal."""

    kind: str = "text"
    tolerance: float | None = None
    relative: float | None = None
    formats: tuple = ()
    left_formats: tuple = ()
    right_formats: tuple = ()
    ignore_case: bool | None = None
    ignore: bool = False


@dataclass(frozen=True)
class Options:
    nulls_equal: bool = True
    ignore_case: bool = False
    tolerance: float = 0.0
    relative: float = 0.0
    rules: dict = field(default_factory=dict)

    def rule(self, column: str) -> Rule:
        return self.rules.get(column, Rule())


def equal(a: Column, b: Column, rule: Rule = Rule(), options: Options = Options()) -> Column:
    """Whether two texts are equal.  Numbers and dates fall back to their texts where one side can't be read."""
    fold = options.ignore_case if rule.ignore_case is None else rule.ignore_case
    x, y = (F.lower(a), F.lower(b)) if fold else (a, b)
    text = x.eqNullSafe(y) if options.nulls_equal else F.coalesce(x == y, F.lit(False))
    tol = options.tolerance if rule.tolerance is None else rule.tolerance
    rel = options.relative if rule.relative is None else rule.relative
    # a general tolerance makes every column a number, unless its own rule says 0
    if rule.kind == "number" or tol or rel:
        p, q = to_double(a), to_double(b)
        bound = F.greatest(F.lit(float(tol)), F.lit(float(rel)) * F.greatest(F.abs(p), F.abs(q)))
        near = ~F.isnan(p - q) & (F.abs(p - q) <= bound)
        return F.when(p.isNotNull() & q.isNotNull(), near).otherwise(text)
    if rule.kind in ("date", "timestamp"):
        p, q = dates.to_stamp(a, list(rule.left_formats or rule.formats) or None), dates.to_stamp(b, list(rule.right_formats or rule.formats) or None)
        if rule.kind == "date":
            p, q = p.cast("date"), q.cast("date")
        return F.when(p.isNotNull() & q.isNotNull(), p == q).otherwise(text)
    return text


def _differs(c: str, options: Options) -> Column:
    return ~equal(F.col(f"{LEFT}.{c}"), F.col(f"{RIGHT}.{c}"), options.rule(c), options)


def with_differences(matched: DataFrame, columns: Sequence[str], options: Options = Options()) -> DataFrame:
    """Adds ``diffs``, the names of the columns in which a pair differs; one-sided rows have none.

    A written match (:func:`snapshot`) has them already, under the options that it was written with."""
    columns = [c for c in columns if not options.rule(c).ignore]
    if BUCKET in matched.columns:
        return matched.withColumn("diffs", F.array_intersect("diffs", F.array(*map(F.lit, columns)) if columns else F.array().cast("array<string>")))
    names = F.array_compact(F.array(*[F.when(_differs(c, options), F.lit(c)) for c in columns])) if columns else F.array().cast("array<string>")
    return matched.withColumn("diffs", F.when(F.col(LEFT).isNotNull() & F.col(RIGHT).isNotNull(), names).otherwise(F.array().cast("array<string>")))


def snapshot(matched: DataFrame, columns: Sequence[str], options: Options = Options()) -> DataFrame:
    """The match with ``diffs`` and ``__bucket__`` (same, differ, left, right), written once, a folder a bucket.

    Every follow-up reads it without an exchange, and those about one bucket read that folder alone."""
    d = with_differences(matched, columns, options)
    l, r = F.col(LEFT).isNotNull(), F.col(RIGHT).isNotNull()
    of = F.when(l & r, F.when(F.size("diffs") > 0, "differ").otherwise("same")).when(l, "left").otherwise("right")
    d = d.withColumn(BUCKET, of)
    path = scratch(matched.sparkSession, "match")
    d.write.partitionBy(BUCKET).parquet(path)
    return matched.sparkSession.read.schema(d.schema).parquet(path)


def within(matched: DataFrame, *buckets: str) -> DataFrame:
    """The rows of some buckets, where the match is a written one; otherwise all rows."""
    return matched.filter(F.col(BUCKET).isin(*buckets)) if BUCKET in matched.columns else matched


def cells(matched: DataFrame, keys: Sequence[str], columns: Sequence[str], options: Options = Options(), occurrence: bool = False) -> DataFrame:
    """keys (and occurrence), column_name, left_value, right_value.  Pairs that agree go before cells are laid out."""
    columns = [c for c in columns if not options.rule(c).ignore]
    pairs = with_differences(within(matched, "differ"), columns, options).filter(F.size("diffs") > 0)
    entry = lambda c: F.when(F.array_contains("diffs", c), F.struct(F.lit(c).alias("column_name"), F.col(f"{LEFT}.{c}").alias("left_value"), F.col(f"{RIGHT}.{c}").alias("right_value")))
    out = pairs.select(*keys, F.col(OCC).alias("occurrence"), F.inline(F.array_compact(F.array(*map(entry, columns)))))
    return out if occurrence else out.drop("occurrence")


def summary(matched: DataFrame, columns: Sequence[str], options: Options = Options()) -> DataFrame:
    """matched, only_left, only_right, diff_rows, cell_diffs and duplicate keys of either side, from one pass."""
    d = with_differences(matched, columns, options)
    l, r = F.col(LEFT).isNotNull(), F.col(RIGHT).isNotNull()
    return d.agg(
        F.count_if(l & r).alias("matched"), F.count_if(l & ~r).alias("only_left"), F.count_if(r & ~l).alias("only_right"), F.count_if(F.size("diffs") > 0).alias("diff_rows"),
        F.coalesce(F.sum(F.size("diffs")), F.lit(0)).cast("long").alias("cell_diffs"), F.count_if(l & (F.col(OCC) > 1)).alias("left_duplicates"), F.count_if(r & (F.col(OCC) > 1)).alias("right_duplicates"),
    )


def one_sided(matched: DataFrame, side: str) -> DataFrame:
    """The whole rows of ``l`` or ``r`` that have no partner."""
    rows = within(matched, "left" if side == LEFT else "right")
    return rows.filter(F.col(RIGHT if side == LEFT else LEFT).isNull()).select(f"{side}.*")


def by_column(cell_rows: DataFrame) -> DataFrame:
    return cell_rows.groupBy("column_name").agg(F.count("*").alias("cells"))


def verdict(matched: int, only_left: int, only_right: int, diff_rows: int, one_sided_columns: int = 0, error: str | None = None) -> str:
    if error:
        return "Error"
    sides = only_left + only_right
    if not (sides or diff_rows or one_sided_columns):
        return "Identical"
    percent = 100 * diff_rows / matched if matched else 100
    return "Small differences" if percent < 5 and sides <= matched else "Differences"
