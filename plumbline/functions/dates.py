"""Date texts: strptime formats as Java patterns, and the first format that reads a text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Strptime letters and their Java pattern letters (one digit is enough, as in strptime).
LETTERS = {"Y": "y", "y": "yy", "m": "M", "d": "d", "b": "MMM", "B": "MMMM", "H": "H", "I": "h", "M": "m", "S": "s", "p": "a", "f": "SSSSSS", "g": "SSS", "n": "SSSSSSSSS"}

# The formats tried, in this order, for a text that no format is given for.
FALLBACK = [
    "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d/%m/%y %H:%M:%S.%n", "%d/%m/%y %H:%M:%S", "%d/%m/%y", "%d-%m-%y",
    "%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y%m%d", "%d-%b-%Y", "%d %b %Y", "%b %d %Y",
]

# What a date or time looks like, and the format that reads it.
PRESETS = {
    "2026-08-27": "%Y-%m-%d", "27/08/2026": "%d/%m/%Y", "08/27/2026": "%m/%d/%Y", "20260827": "%Y%m%d", "27-08-2026": "%d-%m-%Y", "27.08.2026": "%d.%m.%Y",
    "27-Aug-2026": "%d-%b-%Y", "27 August 2026": "%d %B %Y", "Aug 27, 2026": "%b %d, %Y", "27/08/26": "%d/%m/%y", "27/08/26 10:11:12": "%d/%m/%y %H:%M:%S",
    "27/08/26 10:11:12.123456789": "%d/%m/%y %H:%M:%S.%n", "2026-08-27 10:11:12": "%Y-%m-%d %H:%M:%S", "2026-08-27 10:11:12.123": "%Y-%m-%d %H:%M:%S.%g",
    "2026-08-27 10:11:12.123456": "%Y-%m-%d %H:%M:%S.%f", "2026-08-27T10:11:12": "%Y-%m-%dT%H:%M:%S", "27/08/2026 10:11": "%d/%m/%Y %H:%M",
    "27/08/2026 10:11:12 PM": "%d/%m/%Y %I:%M:%S %p", "20260827101112": "%Y%m%d%H%M%S",
}

# Directives without anything between them have all their digits.
TIGHT = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}
_SHAPES = {"Y": r"\d{4}", "y": r"\d{2}", "m": r"\d{1,2}", "d": r"\d{1,2}", "b": "[A-Za-z]{3}", "B": "[A-Za-z]+", "H": r"\d{1,2}", "I": r"\d{1,2}", "M": r"\d{1,2}", "S": r"\d{1,2}", "p": "[AaPp][Mm]", "f": r"\d{1,6}", "g": r"\d{1,3}", "n": r"\d{1,9}"}


def _tight(fmt: str) -> bool:
    return bool(re.search("%[YymdHMS]%[YymdHMS]", fmt))


def java_pattern(fmt: str) -> str:
    """``%d/%m/%Y`` -> ``d/M/y``; letters outside of directives are quoted."""
    out = []
    for part in re.findall("%.|[A-Za-z]+|[^%A-Za-z]+|%", fmt):
        if part[0] == "%" and len(part) == 2:
            if part[1] not in LETTERS:
                raise ValueError(f"format {fmt!r}: %{part[1]} is not known")
            out.append((LETTERS | TIGHT if _tight(fmt) else LETTERS)[part[1]])
        else:
            out.append(f"'{part}'" if part.isalpha() else part)
    return "".join(out)


def shape(fmt: str) -> str:
    """A regular expression for texts of this format: Spark reads some texts that strptime doesn't."""
    digits = _SHAPES | {k: rf"\d{{{len(v)}}}" for k, v in TIGHT.items()} if _tight(fmt) else _SHAPES
    return "^" + "".join(digits[p[1]] if p[0] == "%" and len(p) == 2 else re.escape(p) for p in re.findall("%.|[^%]+|%", fmt)) + "$"


def parse(text: Column, fmt: str) -> Column:
    """A timestamp without zone, null where the text isn't of the format.  Two-digit years from 69 on are 19xx."""
    t = F.btrim(text)
    pattern = java_pattern(fmt)
    if "%n" in fmt or "%f" in fmt or "%g" in fmt:  # fractions of any length, cut at microseconds
        t = F.regexp_replace(t, r"\.(\d{1,6})\d*", r".$1")
        pattern = re.sub(r"\.S+", "[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", pattern)
    got = F.try_to_timestamp(F.when(F.btrim(text).rlike(shape(fmt)), F.initcap(t) if re.search("%[bB]", fmt) else F.upper(t) if "%p" in fmt else t), F.lit(pattern)).cast("timestamp_ntz")
    if "%y" in fmt:
        got = F.when(F.year(got) >= 2069, got - F.expr("INTERVAL 100 YEARS")).otherwise(got)
    return got


def parse_any(text: Column, formats: list[str] | None = None) -> Column:
    return F.coalesce(*[parse(text, f) for f in formats or FALLBACK])


def cast_date(text: Column) -> Column:
    """ISO dates and timestamps alone; what starts as d/ or dd- is left to the formats."""
    t = F.btrim(text)
    iso = t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?)?$")
    return F.when(iso, F.replace(t, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"))


def to_stamp(text: Column, formats: list[str] | None = None) -> Column:
    return F.coalesce(*([parse_any(text, formats)] if formats else []), cast_date(text), parse_any(text))
