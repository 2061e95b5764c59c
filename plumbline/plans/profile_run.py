"""The whole profile of one table: every measure of :mod:`profile` and :mod:`observe` that fits its columns' kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates
from ..functions.values import to_double
from ..operators import keys, notes, observe, profile, sniff


def tables(df: DataFrame, kinds: dict[str, str] | None = None, today: str | None = None) -> dict[str, DataFrame]:
    """Tables by name, none worked out yet; ``kinds`` (column: text, number, date, timestamp, boolean) are sniffed where
    they are not given.  Measures that no column allows are left out."""
    kinds = kinds or sniff.looks_like(df, df.columns)
    of = lambda *ks: [c for c in df.columns if kinds.get(c) in ks]
    numbers, stamps, text = of("number"), of("date", "timestamp"), of("text")
    read = df.withColumns({c: to_double(F.col(c).cast("string")) for c in numbers} | {c: dates.to_stamp(F.col(c).cast("string")) for c in stamps})
    out = {"statistics": profile.statistics(df, df.columns, numbers), "most_frequent": profile.top_values(df, df.columns), "least_frequent": profile.top_values(df, df.columns, least=True)}
    if text:
        out |= {"shapes": observe.shapes(df, text), "odd_shapes": observe.odd_shapes(df, text), "raw_checks": observe.raw_checks(df, text)}
    if numbers:
        out["outliers"] = observe.outliers(read, numbers)
    if len(numbers) > 1:
        out["correlations"] = observe.correlations(read, numbers)
    if stamps:
        out["date_outliers"] = observe.date_outliers(read, stamps, today)
    return out


def findings(df: DataFrame, kinds: dict[str, str] | None = None, deepest: int = 3, today: str | None = None) -> dict[str, DataFrame]:
    """keys (columns, distinct_values, unique, reasons), dependencies (a decides b), notes (a sentence each, the headline
    first, with the figures of a column's finding) and casts (text columns that read as another kind).  Searches run here; the driver
    holds column names, counts and the findings, some rows a column."""
    kinds = kinds or sniff.looks_like(df, df.columns)
    spark, columns = df.sparkSession, df.columns
    text, numbers = ([c for c in columns if kinds.get(c) == k] for k in ("text", "number"))
    found = keys.search(df, columns, deepest)
    rows = [(",".join(c.columns), c.distinct, c.unique, "; ".join(c.reasons())) for c in found]
    decided = observe.dependencies(df, columns)
    noted = notes.column_notes(df, kinds, today).select("column_name", "note", "n", "percent", "example").collect()
    repeats = observe.duplicate_rows(df).first()["duplicates"]
    read = df.select(*[to_double(F.col(c).cast("string")).alias(c) for c in numbers])
    related = observe.correlations(read, numbers).collect() if len(numbers) > 1 else []  # a row a pair of columns
    said = [notes.headline(columns, df.count(), repeats, next((c.columns for c in found if c.unique), ()), noted)]
    said = [(None, None, None, None, None, text) for text in said + notes.table_sentences(repeats, decided, related)]
    said = said[:1] + notes.sentences(noted, columns) + said[1:]
    out = {
        "keys": spark.createDataFrame(rows, "columns string, distinct_values long, unique boolean, reasons string"),
        "dependencies": spark.createDataFrame(decided, "a string, b string"),
        "notes": spark.createDataFrame(said, "column_name string, finding string, n long, percent double, example string, note string"),
    }
    return out | ({"casts": sniff.casts(df, text)} if text else {})


def write(df: DataFrame, folder: str, kinds: dict[str, str] | None = None, today: str | None = None, searches: bool = True) -> list[str]:
    """Writes each table as Parquet, with ``searches`` the findings too, and returns their names."""
    kinds = kinds or sniff.looks_like(df, df.columns)
    made = tables(df, kinds, today) | (findings(df, kinds, today=today) if searches else {})
    for name, table in made.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return list(made)
