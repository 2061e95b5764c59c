"""What a text column could be: suggestions, possible kinds and the formats that read it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates
from ..functions.values import is_number, null_fold, to_double
from ..written import settle
from .profile import long_counts

SHARE, CAST_SHARE = 0.98, 0.90
DAY_FIRST, MONTH_FIRST = "%d/%m/%Y", "%m/%d/%Y"
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "t", "f")  # fixed values; 1 and 0 are numbers


def readings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, filled, booleans, numbers, stamps, with_time: how many filled values each kind reads.

    Distinct values are read once, whatever the number of rows."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), null_fold(F.col(c).cast("string")).alias("v")) for c in columns])))
    v = long.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    stamp = dates.to_stamp(F.col("v"))
    v = v.withColumn("stamp", F.when(F.length("v") <= 40, stamp))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return v.groupBy("column_name").agg(
        total(F.col("v").isNotNull()).alias("filled"), total(F.lower(F.trim("v")).isin(*BOOLEAN_WORDS)).alias("booleans"), total(is_number(F.col("v"))).alias("numbers"),
        total(F.col("stamp").isNotNull()).alias("stamps"), total(F.date_format("stamp", "HH:mm:ss") != "00:00:00").alias("with_time"),
    )


def spellings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By column, how many filled values read as a number, as one once its commas go (grouped), as a boolean, as an ISO
    date, as day/month/year, as month/day/year, as any date (stamps) and with a time of day; an empty table gives no row.

    Distinct values are read once, as in :func:`readings`."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), null_fold(F.col(c).cast("string")).alias("v")) for c in columns])))
    v = long.groupBy("column_name", "v").agg(F.count("*").alias("n")).withColumn("stamp", F.when(F.length("v") <= 40, dates.to_stamp(F.col("v"))))
    text = F.col("v")
    tests = {
        "filled": text.isNotNull(), "numbers": is_number(text), "grouped": is_number(F.replace(text, F.lit(","), F.lit(""))), "booleans": F.lower(F.trim(text)).isin(*BOOLEAN_WORDS), "iso": dates.cast_date(text).isNotNull(),
        "day_first": dates.parse(text, DAY_FIRST).isNotNull(), "month_first": dates.parse(text, MONTH_FIRST).isNotNull(), "stamps": F.col("stamp").isNotNull(), "with_time": F.date_format("stamp", "HH:mm:ss") != "00:00:00",
    }
    return v.groupBy("column_name").agg(*[F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long").alias(name) for name, test in tests.items()])


def looks_like(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """boolean before number before date or timestamp; booleans must be all, the others 98 % of filled values."""
    out = {}
    for r in readings(df, columns).collect():
        n = r["filled"]
        kind = "text"
        if n and r["booleans"] == n:
            kind = "boolean"
        elif n and r["numbers"] >= SHARE * n:
            kind = "number"
        elif n and r["stamps"] >= SHARE * n:
            kind = "timestamp" if r["with_time"] else "date"
        out[r["column_name"]] = kind
    return out


def formats_that_read(df: DataFrame, column: str, formats: Sequence[str] = tuple(dates.PRESETS.values())) -> DataFrame:
    """format, n, share of filled values it reads, best first."""
    v = df.select(null_fold(F.col(column).cast("string")).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    row = v.agg(F.sum("n").alias("filled"), *[F.coalesce(F.sum(F.when(dates.parse(F.col("v"), f).isNotNull(), F.col("n"))), F.lit(0)).alias(f"f{i}") for i, f in enumerate(formats)])
    long = row.select("filled", F.inline(F.array(*[F.struct(F.lit(f).alias("format"), F.col(f"f{i}").alias("n")) for i, f in enumerate(formats)])))
    return long.filter("n > 0").withColumn("share", F.round(F.col("n") / F.col("filled"), 4)).drop("filled")


def possible_kinds(df: DataFrame, column: str, formats: Sequence[str] = tuple(dates.PRESETS.values())) -> DataFrame:
    """kind, format: every way to read the column that fits 98 % of its filled values; text always does.

    A format with a four-digit year is left out where its two-digit twin fits too."""
    r = readings(df, [column])
    plain = r.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(n).alias("n"), "filled") for k, n in (("number", "numbers"), ("boolean", "booleans"), ("text", "filled"))])))
    plain = plain.filter((F.col("kind") == "text") | ((F.col("filled") > 0) & (F.col("n") >= SHARE * F.col("filled")))).select("kind", F.lit(None).cast("string").alias("format"))
    fits = formats_that_read(df, column, formats).filter(F.col("share") >= SHARE).select("format")
    twins = fits.filter(F.col("format").contains("%y")).select(F.replace("format", F.lit("%y"), F.lit("%Y")).alias("format"))
    stamp = F.when(F.col("format").rlike("%[HI]"), "timestamp").otherwise("date")
    return plain.union(fits.join(F.broadcast(twins), "format", "left_anti").select(stamp.alias("kind"), "format"))


# The forms that a text is tried in, after ISO; a trailing Z is dropped first, %n takes one to nine digits.
DATE_FORMS = ("%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%d.%m.%Y", "%Y/%m/%d", "%d %b %Y", "%Y%m%d")
TIME_FORMS = (
    "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%m/%d/%Y %H:%M", "%Y/%m/%d %H:%M:%S", "%d-%m-%Y %H:%M:%S", "%Y%m%d %H:%M:%S",
    "%Y%m%d-%H:%M:%S", "%Y%m%dT%H%M%S", "%Y%m%d%H%M%S",
)
FRACTION_FORMS = tuple(f"{f}.%n" for f in TIME_FORMS if f.endswith("%S"))
YEARS = (1900, 2100)  # plausible ones, so that a long identifier isn't a date


def _tries(v: Column, numbers: bool) -> list[tuple[str, str, Column]]:
    """(kind, form, whether the value reads so)."""
    likely = lambda t: F.coalesce(F.year(t).between(*YEARS), F.lit(False))
    finite = lambda t: F.coalesce(is_number(t) & (F.abs(to_double(t)) < float("inf")), F.lit(False))
    out = [("number", "plain", finite(v)), ("number", "with , removed", finite(F.replace(v, F.lit(","), F.lit(""))))] if numbers else []
    iso, short, bare = dates.cast_date(v), F.length(v) <= 10, F.regexp_replace(v, "Z+$", "")
    out += [("date", "ISO", likely(iso) & short)] + [("date", f, likely(dates.parse(bare, f))) for f in DATE_FORMS]
    return out + [("timestamp", "ISO", likely(iso) & ~short)] + [("timestamp", f, likely(dates.parse(bare, f))) for f in TIME_FORMS + FRACTION_FORMS]


def casts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, kind, filled, reads (in any form), form and n (the one that most read in, the first of ties), before and
    after (for numbers: the most digits before and after the point).

    A row for each column and kind (number, date, timestamp) that some filled value reads as; number columns are tried as
    dates and timestamps alone.  Every form is tried on each different value, in one pass for all columns."""
    numeric = [c for c, t in df.dtypes if c in columns and t.startswith(("int", "bigint", "smallint", "tinyint", "double", "float", "decimal"))]
    text = df.select(*[(F.regexp_replace(F.col(c).cast("string"), r"\.0$", "") if c in numeric else F.nullif(F.btrim(c), F.lit(""))).alias(c) for c in columns])
    v = settle(long_counts(text, columns).filter("value is not null"), "values")
    is_numeric = F.col("column_name").isin(numeric) if numeric else F.lit(False)
    tries = _tries(F.col("value"), True)
    entry = lambda i, t: F.when(t[2] & ~(is_numeric & (F.lit(t[0]) == "number")), F.lit(i))
    read = v.withColumn("forms", F.array_compact(F.array(*[entry(i, t) for i, t in enumerate(tries)])))
    kind_of = F.array(*[F.lit(t[0]) for t in tries])
    form_of = F.array(*[F.lit(t[1]) for t in tries])
    bare = F.regexp_replace(F.replace("value", F.lit(","), F.lit("")), "^[-+]", "")
    read = settle(read.select("column_name", "value", "n", "forms", F.length(F.split_part(bare, F.lit("."), F.lit(1))).alias("left"), F.length(F.split_part(bare, F.lit("."), F.lit(2))).alias("right")), "read")
    filled = v.groupBy("column_name").agg(F.sum("n").alias("filled"))
    kinds = read.select("*", F.explode(F.array_distinct(F.transform("forms", lambda i: kind_of[i]))).alias("kind"))
    number = F.col("kind") == "number"
    kinds = kinds.groupBy("column_name", "kind").agg(F.sum("n").alias("reads"), F.max(F.when(number, F.col("left"))).alias("before"), F.max(F.when(number, F.col("right"))).alias("after"))
    forms = read.select("column_name", "n", F.explode("forms").alias("i")).groupBy("column_name", "i").agg(F.sum("n").alias("n"))
    best = forms.groupBy("column_name", kind_of[F.col("i")].alias("kind")).agg(F.max("n").alias("n"), F.min_by("i", F.struct((-F.col("n")).alias("m"), "i")).alias("i"))
    out = kinds.join(F.broadcast(best), ["column_name", "kind"]).join(F.broadcast(filled), "column_name")  # a few rows for each column
    return out.select("column_name", "kind", "filled", "reads", form_of[F.col("i")].alias("form"), "n", "before", "after")


def reads_as(row: dict | None, share: float = 0.9) -> str:
    """timestamp or date, where that share of a column's filled values reads so; ``row``: kind to (filled, reads)."""
    return next((k for k in ("timestamp", "date") if row and k in row and row[k][1] >= share * row[k][0]), "")
