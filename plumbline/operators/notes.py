"""What stands out in the columns of a table: a row a finding, worked out from one written table of values and counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions import dates
from ..functions.values import to_double
from ..written import settle
from .keys import ID_WORDS, words_of
from .observe import date_outliers, odd_shapes, outliers
from .profile import long_counts

# Percentages from which a column is named, the values of a category, how many of them are listed.
EMPTY_FROM, NEARLY_UNIQUE, DOMINANT, ODD_FROM, CATEGORY_UP_TO = 5, 99, 95, 90, 50
CATEGORY, LISTED, SPELLINGS = 20, 12, 3
NOTE = "struct<note:string,n:long,percent:double,example:string>"

# What each finding says; ``n`` and ``percent`` are rows (of a category: values), ``example`` is text.
SENTENCES = {
    "empty": "{c} is always empty", "constant": "{c} has one value: {example}", "nulls": "{c} is empty on {percent:.2f} % of rows", "unique": "{c} is unique",
    "nearly_unique": "{c} is nearly unique: {n:,} rows share a value with another", "identifier_repeats": "{c} is named like an identifier, but {n:,} rows share a value with another",
    "category": "{c} is a category of {n} values: {example}", "dominant": "{c} is {example} on {percent:.2f} % of rows", "leading_zeros": "{c} reads as a number, but {n:,} values begin with a zero",
    "case": "{c} has {n:,} values that differ in case alone, such as {example}", "padded": "{c} has spaces around {n:,} values", "outliers": "{c} has {n:,} outliers", "not_finite": "{c} has {n:,} values that no outlier measure can take",
    "negatives": "{c} is negative on {n:,} rows", "zeros": "{c} is zero on {n:,} rows", "future": "{c} lies after today on {n:,} rows", "before_1900": "{c} lies before 1900 on {n:,} rows", "odd_shapes": "{c} has another shape on {n:,} rows, such as {example}",
}


def _listed(counts: DataFrame, facts: DataFrame) -> DataFrame:
    """The most frequent values of columns with few of them."""
    few = facts.filter(f"`values` between 2 and {CATEGORY}").select("column_name")  # a row for each column
    rows = counts.join(F.broadcast(few), "column_name").filter("value is not null")
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    first = rows.withColumn("rank", rank).filter(F.col("rank") <= LISTED)  # cut before the exchange
    return first.groupBy("column_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), ", ").alias("listed"))


def _spelled(counts: DataFrame, text: Sequence[str]) -> DataFrame:
    """By column: the values that share a lower-cased form with others, and the first spellings of the form with most."""
    rows = counts.filter(F.col("column_name").isin(list(text)) & F.col("value").isNotNull()).withColumn("low", F.lower("value"))
    forms = rows.groupBy("column_name", "low").agg(F.count("*").alias("forms"), F.sum("n").alias("rows")).filter("forms > 1")
    worst = forms.groupBy("column_name").agg(F.sum("forms").alias("alike"), F.min_by("low", F.struct((-F.col("forms")).alias("a"), (-F.col("rows")).alias("b"), "low")).alias("low"))
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    first = rows.join(F.broadcast(worst), ["column_name", "low"]).withColumn("rank", rank).filter(F.col("rank") <= SPELLINGS)  # a row for each column
    return first.groupBy("column_name", "alike").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), " / ").alias("spellings"))


def column_notes(df: DataFrame, kinds: dict[str, str], today: str | None = None) -> DataFrame:
    """column_name, note, n, percent (of all rows), example; the notes are the keys of ``SENTENCES``.

    ``kinds`` (column: text, number, date, timestamp, boolean) say which measures a column gets; one without a kind gets
    those of any kind.  A column without a finding gives no row, as does a table without columns or rows; cells that
    don't read as their kind count as filled, but are no outliers.  Ties go to the lesser value."""
    if not df.columns:
        raise ValueError("a table without columns has no notes")
    of = lambda *some: [c for c in df.columns if kinds.get(c) in some]
    text, numbers, stamps = of("text"), of("number"), of("date", "timestamp")
    counts = settle(long_counts(df, df.columns), "counts")
    v, n, there = F.col("value"), F.col("n"), F.col("value").isNotNull()
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    facts = counts.groupBy("column_name").agg(
        F.sum("n").alias("rows"), total(there).alias("filled"), F.count("value").alias("values"), F.min_by("value", F.when(there, F.struct((-n).alias("m"), "value"))).alias("top"),
        F.max(F.when(there, n)).alias("top_n"), total(v != F.trim(v)).alias("padded"), total(v.rlike("^0[0-9]")).alias("leading_zeros"),
    )
    facts = settle(facts, "facts")  # a row for each column
    parts = [_listed(counts, facts)]
    if text:
        parts += [_spelled(counts, text), odd_shapes(df, text, ODD_FROM).select("column_name", F.col("others"), F.array_join(F.concat("examples", F.when(F.col("more"), F.array(F.lit("…"))).otherwise(F.array().cast("array<string>"))), ", ").alias("odd"))]
    measured = []
    if numbers:
        read = df.select(*[to_double(F.col(c).cast("string")).alias(c) for c in numbers])
        measured.append(outliers(read, numbers).select("column_name", (F.col("below") + F.col("above")).alias("outside"), "left_out", "negatives", "zeros"))
    if stamps:
        read = df.select(*[dates.to_stamp(F.col(c).cast("string")).alias(c) for c in stamps])
        measured.append(date_outliers(read, stamps, today).select("column_name", (F.col("below") + F.col("above")).alias("outside"), "future", "before_1900"))
    if measured:
        parts.append(measured[0] if len(measured) == 1 else measured[0].unionByName(measured[1], allowMissingColumns=True))
    for part in parts:
        facts = facts.join(part, "column_name", "left")
    return facts.select("column_name", F.inline(F.array_compact(F.array(*_rules(facts.columns, [c for c in df.columns if any(w in ID_WORDS for w in words_of(c))], text, numbers)))))


def _rules(have: Sequence[str], identifiers: Sequence[str], text: Sequence[str], numbers: Sequence[str]) -> Iterable[Column]:
    """A struct for each finding that a row of facts allows, null for the others."""
    rows, filled, values = F.col("rows"), F.col("filled"), F.col("values")
    among = lambda names: F.col("column_name").isin(list(names)) if names else F.lit(False)
    shared, nulls, unlike = filled - values, rows - filled, 100 * values < NEARLY_UNIQUE * filled

    def note(name: str, when: Column, n: Column, example: Column | None = None) -> Column:
        share = F.round(100.0 * n / rows, 2)
        return F.when(when, F.struct(F.lit(name).alias("note"), n.cast("long").alias("n"), share.alias("percent"), (F.lit(None) if example is None else example).cast("string").alias("example")).cast(NOTE))

    yield note("empty", filled == 0, rows)
    yield note("constant", values == 1, filled, F.col("top"))
    yield note("nulls", (filled > 0) & (nulls > 0) & ((100 * nulls >= EMPTY_FROM * rows) | among(identifiers)), nulls)
    yield note("unique", (values == rows) & (rows > 1), rows)
    yield note("nearly_unique", ~unlike & (shared > 0), shared)
    yield note("identifier_repeats", unlike & (shared > 0) & among(identifiers), shared)
    yield note("category", values.between(2, CATEGORY) & (100 * values <= CATEGORY_UP_TO * rows), values, F.concat("listed", F.when(values > LISTED, ", …").otherwise("")))
    yield note("dominant", (values > 1) & (100 * F.col("top_n") >= DOMINANT * rows), F.col("top_n"), F.col("top"))
    yield note("leading_zeros", among(numbers) & (F.col("leading_zeros") > 0), F.col("leading_zeros"))
    yield note("padded", among(text) & (F.col("padded") > 0), F.col("padded"))
    for name, column, example in (("case", "alike", "spellings"), ("outliers", "outside", None), ("not_finite", "left_out", None), ("negatives", "negatives", None), ("zeros", "zeros", None), ("future", "future", None), ("before_1900", "before_1900", None), ("odd_shapes", "others", "odd")):
        if column in have:
            yield note(name, F.coalesce(F.col(column), F.lit(0)) > 0, F.col(column), F.col(example) if example else None)


def sentences(rows: Iterable[Row], columns: Sequence[str]) -> list[tuple]:
    """(column_name, finding, n, percent, example, sentence), in the order of the columns and of ``SENTENCES``."""
    order = list(SENTENCES)
    listed = sorted(rows, key=lambda r: (list(columns).index(r["column_name"]), order.index(r["note"])))
    return [(*r, SENTENCES[r["note"]].format(c=r["column_name"], n=r["n"], percent=r["percent"], example=r["example"])) for r in listed]


def table_sentences(duplicates: int, dependencies: Sequence[tuple[str, str]], correlations: Sequence[Row] = ()) -> list[str]:
    """What concerns the table: rows repeated whole, columns that decide others (both ways: one-to-one), correlations."""
    both = {frozenset(p) for p in dependencies if tuple(reversed(p)) in set(dependencies)}
    out = [f"{duplicates:,} rows repeat another in every column"] if duplicates else []
    out += [f"{a} and {b} are one-to-one" for a, b in sorted(map(sorted, both))]
    out += [f"each {a} has one {b}" for a, b in dependencies if frozenset((a, b)) not in both]
    return out + [f"{r['a']} and {r['b']} are correlated, r = {r['r']:.2f}" for r in correlations]


def headline(columns: Sequence[str], rows: int, duplicates: int, key: Sequence[str], found: Iterable[Row]) -> str:
    """A line for the table: its size, key, repeated rows and how many columns are empty, constant or have outliers."""
    count = lambda k, one: f"{k:,} {one}{'' if k == 1 else 's'}"
    kinds = [r["note"] for r in found]
    counted = [count(kinds.count(note), f"{said} column") for note, said in (("empty", "empty"), ("constant", "constant"), ("outliers", "outlying")) if note in kinds]
    return " · ".join([f"{count(rows, 'row')} x {count(len(columns), 'column')}", *(["key: " + ", ".join(key)] if key else []), count(duplicates, "repeated row"), *counted])
