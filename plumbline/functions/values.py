"""Values as canonical text: null folding, transform steps and the readings number, date, timestamp and boolean.

Every function maps columns to columns.  A text that can't be read as its kind is kept as it is, so that it shows up
as a difference."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from . import dates

KINDS = ("text", "number", "date", "timestamp", "boolean")
NULL_TOKENS = ("NULL", "\\N", "N/A", "NA", "NAN", "NONE", "(NULL)", "")  # fixed values
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_SPACES = " \t\n\r\u00a0"


def null_fold(value: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    return F.when(~F.upper(F.btrim(value)).isin([t.upper() for t in tokens]), value)


def is_number(text: Column) -> Column:
    return F.btrim(text).rlike(_NUMBER) | F.lower(F.btrim(text)).isin("inf", "-inf", "+inf", "infinity", "-infinity", "nan")


def to_double(text: Column) -> Column:
    return F.when(is_number(text), F.btrim(text).try_cast("double"))


def strip_zeros(text: Column) -> Column:
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def double_text(value: Column) -> Column:
    """Plain digits between 1e-5 and 1e16, else d.ddde+XX with two exponent digits at least."""
    s = value.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(s, r"^(.*)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    sci = F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = value.try_cast("decimal(38,15)").cast("string")
    small = (F.abs(value) >= 1e-4) & (F.abs(value) < 1e16)
    return F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").when(small, F.when(s.contains("E"), strip_zeros(plain)).otherwise(F.regexp_replace(s, r"\.0$", ""))).when(s.contains("E"), sci).otherwise(F.regexp_replace(s, r"\.0$", ""))


def canon_number(text: Column) -> Column:
    """Up to eight places as DECIMAL(18,8), else DECIMAL(38,10), else a double; no trailing zeros."""
    t = F.btrim(text)
    plain = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")
    short = plain & (F.length(F.split_part(t, F.lit("."), F.lit(2))) <= 8)
    exact = lambda kind: strip_zeros(t.try_cast(kind).cast("string"))
    number = F.coalesce(F.when(short, exact("decimal(18,8)")), F.when(is_number(t) & ~F.lower(t).rlike("inf|nan"), exact("decimal(38,10)")), double_text(to_double(t)))
    return F.coalesce(F.when(number == "-0", "0").otherwise(number), text)


def canon_date(text: Column, formats: list[str] | None = None) -> Column:
    return F.coalesce(dates.to_stamp(text, formats).cast("date").cast("string"), text)


def canon_timestamp(text: Column, formats: list[str] | None = None) -> Column:
    return F.coalesce(dates.to_stamp(text, formats).cast("string"), text)


def to_boolean(text: Column) -> Column:
    return F.btrim(text).try_cast("boolean")


def canon_boolean(text: Column) -> Column:
    return F.coalesce(to_boolean(text).cast("string"), text)


def canonical(text: Column, kind: str = "text", formats: list[str] | None = None, trim: bool = True) -> Column:
    if kind not in KINDS:
        raise ValueError(f"kind {kind!r} is none of {', '.join(KINDS)}")
    if kind == "text":
        return F.btrim(text) if trim else text
    return {"number": canon_number, "boolean": canon_boolean}[kind](text) if kind in ("number", "boolean") else {"date": canon_date, "timestamp": canon_timestamp}[kind](text, formats)


def _blank(x: Column) -> Column:
    return x.isNull() | (F.btrim(x, F.lit(_SPACES)) == "")


def _left(x: Column, n: int) -> Column:
    return F.left(x, F.lit(n)) if n >= 0 else F.left(x, F.greatest(F.length(x) + n, F.lit(0)))


def _right(x: Column, n: int) -> Column:
    return F.right(x, F.lit(n)) if n >= 0 else F.right(x, F.greatest(F.length(x) + n, F.lit(0)))


def _part(x: Column, sep: str, n: int) -> Column:
    if n == 0:
        raise ValueError("parts are counted from 1, or from -1 backwards")
    if sep == "":
        return F.substring(x, n, 1)
    return F.split_part(x, F.lit(sep), F.lit(n))


def _replace(x: Column, find: str, by: str = "") -> Column:
    if not find:
        raise ValueError("the text to find is empty")
    return F.replace(x, F.lit(find), F.lit(by))


def _regex(x: Column, pattern: str, by: str = "") -> Column:
    import re

    return F.regexp_replace(x, pattern, re.sub(r"\\(\d)", r"$\1", by))


def _expression(x: Column, text: str) -> Column:
    """A Spark SQL expression of ``x``, the value so far."""
    if ";" in text:
        raise ValueError("an expression can't hold ';'")
    return F.element_at(F.transform(F.array(x), lambda v: F.expr(text)), 1) if "x" not in text else F.call_function("transform", F.array(x), F.expr(f"x -> {text}")).getItem(0)


# name: (parameters, function); parameters are literals
STEPS: dict[str, Callable[..., Column]] = {
    "trim": lambda x: F.trim(x),
    "upper": lambda x: F.upper(x),
    "lower": lambda x: F.lower(x),
    "left": _left,
    "right": _right,
    "length": lambda x: F.length(x).cast("string"),
    "substring": lambda x, start, n: F.substring(x, start, n),
    "replace": _replace,
    "regex_replace": _regex,
    "remove_spaces": lambda x: F.replace(x, F.lit(" "), F.lit("")),
    "collapse_spaces": lambda x: F.regexp_replace(F.trim(x), " +", " "),
    "strip_leading_zeros": lambda x: F.regexp_replace(x, "^0+", ""),
    "pad_left": lambda x, n, char="0": F.lpad(x, n, char),
    "digits_only": lambda x: F.regexp_replace(x, "[^0-9]", ""),
    "letters_digits_only": lambda x: F.regexp_replace(x, "[^A-Za-z0-9]", ""),
    "split_part": _part,
    "remove_thousands": lambda x: F.replace(x, F.lit(","), F.lit("")),
    "if_empty": lambda x, value: F.when(_blank(x), F.lit(value)).otherwise(x),
    "to_number": canon_number,
    "to_date": lambda x, fmt=None: canon_date(x, [fmt] if fmt else None),
    "to_timestamp": lambda x, fmt=None: canon_timestamp(x, [fmt] if fmt else None),
    "to_boolean": canon_boolean,
    "expression": _expression,
}


def apply_steps(value: Column, steps: Sequence[tuple]) -> Column:
    """Steps (name, parameters...) from left to right."""
    for name, *args in steps:
        if name not in STEPS:
            raise ValueError(f"step {name!r} is not known; there are {', '.join(STEPS)}")
        value = STEPS[name](value, *args)
    return value


@dataclass(frozen=True)
class ColSpec:
    """A compared column: its name, where it comes from, its kind and what is done to it first."""

    name: str
    source: str | None = None
    kind: str = "text"
    steps: tuple = ()
    formats: tuple = ()
    fold: bool = True
    trim: bool = True

    def column(self) -> Column:
        """Steps, then null folding, then trimming and typing."""
        raw = apply_steps(F.col(self.source or self.name).cast("string"), self.steps)
        folded = null_fold(raw) if self.fold else raw
        return canonical(folded, self.kind, list(self.formats) or None, self.trim).alias(self.name)


def canonicalise(df: DataFrame, specs: Sequence[ColSpec], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[s.column() for s in specs])


def stages(df: DataFrame, spec: ColSpec, keep: Sequence[str] = ()) -> DataFrame:
    """What becomes of each value of a column: in_file, after_steps, compared_as, and whether it converts to its kind
    (null where it is text or null)."""
    after = apply_steps(F.col("in_file"), spec.steps)
    rows = df.select(*keep, F.col(spec.source or spec.name).cast("string").alias("in_file")).withColumn("after_steps", after)
    folded = null_fold(F.col("after_steps")) if spec.fold else F.col("after_steps")
    rows = rows.withColumn("folded", folded).withColumn("compared_as", canonical(F.col("folded"), spec.kind, list(spec.formats) or None, spec.trim))
    converts = F.lit(None).cast("boolean") if spec.kind == "text" else F.when(F.col("folded").isNotNull(), readable(F.col("folded"), spec.kind))
    return rows.withColumn("converts", converts).drop("folded")


def as_read(text: Column, kind: str) -> Column:
    """How a text reads as a kind; as it is where it doesn't."""
    return {"number": lambda: canon_number(text), "date": lambda: canon_date(text), "timestamp": lambda: F.coalesce(dates.to_stamp(text).cast("string"), text), "boolean": lambda: F.coalesce(to_boolean(text).cast("string"), text)}.get(kind, lambda: text)()


def readable(text: Column, kind: str) -> Column:
    return {"number": lambda: is_number(text), "boolean": lambda: to_boolean(text).isNotNull(), "date": lambda: dates.to_stamp(text).isNotNull(), "timestamp": lambda: dates.to_stamp(text).isNotNull()}.get(kind, lambda: text.isNotNull())()


def conversion_report(df: DataFrame, column: str, kind: str) -> DataFrame:
    """filled, converted, failed, failed_percent, the least and greatest text that failed, and an example: the least text
    as written and as it is read."""
    x = null_fold(F.col(column).cast("string"))
    rows = df.select(x.alias("x")).withColumn("ok", readable(F.col("x"), kind))
    bad = F.when(~F.col("ok"), F.col("x"))
    out = rows.agg(F.count("x").alias("filled"), F.count_if("ok").alias("converted"), F.min(bad).alias("first_failed"), F.max(bad).alias("last_failed"), F.min("x").alias("before"))
    failed = F.col("filled") - F.col("converted")
    return out.select("filled", "converted", failed.alias("failed"), F.round(F.try_divide(100.0 * failed, F.col("filled")), 2).alias("failed_percent"), "first_failed", "last_failed", "before", as_read(F.col("before"), kind).alias("after"))


# Ready-made columns from another one, by name: cells that don't read give null.
DERIVED: dict[str, Callable[[Column], Column]] = {
    "date": lambda x: dates.to_stamp(x).cast("date").cast("string"),
    "hour": lambda x: F.date_format(F.date_trunc("hour", dates.to_stamp(x)), "yyyy-MM-dd HH:mm:ss"),
    "minute": lambda x: F.date_format(F.date_trunc("minute", dates.to_stamp(x)), "yyyy-MM-dd HH:mm:ss"),
    "month": lambda x: F.date_format(dates.to_stamp(x), "yyyy-MM"),
    "year": lambda x: F.year(dates.to_stamp(x)).cast("string"),
    "upper": lambda x: F.upper(F.trim(x)),
    "round": lambda x: double_text(F.round(to_double(x), 2)),
}


def derived(name: str, value: Column) -> Column:
    if name not in DERIVED:
        raise ValueError(f"no ready-made column {name!r}; there are {', '.join(DERIVED)}")
    return DERIVED[name](value.cast("string"))
