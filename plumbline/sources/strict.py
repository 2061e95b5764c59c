"""Strict reading of delimited text: rows wider than expected are set aside, shorter ones are filled up.

A file is read by many tasks although quoted fields may hold line feeds.  Lines get their numbers once; whether a line
begins a row follows from the parity of the quotes before it.  Chunks of ``CHUNK`` lines are counted on their own, for
both parities that they may begin with; a running sum over the chunks, a row each, says which one it was.  Only lines of
rows that span several are brought together."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.match import numbered

CHUNK = 50_000  # lines that are counted together
LONGEST = 10_000  # lines of a row that are kept: more come from a quote that is never closed


@dataclass
class Strict:
    rows: DataFrame
    set_aside: DataFrame
    widths: DataFrame
    expected: int

    def page(self, offset: int = 0, n: int = 50) -> DataFrame:
        """Set-aside rows in file order."""
        return self.set_aside.orderBy("file", "line").offset(offset).limit(n)

    def messages(self, most: int = 10) -> list[str]:
        """What is wrong with the rows that aren't of the expected width, the most frequent widths first, and what mostly
        causes it: an unquoted decimal comma, or a comma before a time's fraction."""
        odd = self.widths.filter(F.col("width") != self.expected).orderBy(F.desc("n"), "width").limit(most).collect()
        fate = lambda w: "set aside" if w > self.expected else "filled up with nulls"
        said = [f"{r['n']} rows have {r['width']} fields, {self.expected} are expected: {fate(r['width'])}" for r in odd]
        if any(r["width"] > self.expected for r in odd):
            wide, reads = F.col("problem") != OPEN, lambda p: F.col("raw").rlike(p)
            n, times, numbers, open_at = self.set_aside.agg(F.count_if(wide), F.count_if(wide & reads(r"\d\d:\d\d:\d\d,\d+(?:,|$)")), F.count_if(wide & reads(r"(?:^|,)-?\d+,\d+(?:,|$)")), F.min(F.when(~wide, F.col("line")))).first()
            if times * 2 > n:
                said.append("most of them have a time followed by a comma and digits: export fractions of a second with a point, or quote them")
            elif numbers * 2 > n:
                said.append("most of them have whole numbers side by side: a decimal comma, perhaps; export with another delimiter or with decimal points")
            if open_at is not None:
                said.append(f"line {open_at} opens a quote that never closes")
        return said


OPEN = "a quote is not closed"


def _unquoted(raw: Column, quote: str) -> Column:
    """What stands outside of quotes; every quote opens or closes."""
    q = re.escape(quote)
    return F.regexp_replace(raw, f"{q}[^{q}]*+(?:{q}|$)", "")


def modal_width(widths: DataFrame) -> int | None:
    """The most frequent width, the lesser among equals."""
    row = widths.orderBy(F.desc("n"), "width").first()
    return row["width"] if row else None


def text_rows(spark: SparkSession, path: str | list[str], quote: str = '"', skip: int = 0) -> DataFrame:
    """file, line (the row's first, from 1), record (0 for a file's first row, blank lines aside), lines, raw, open.

    ``raw`` is the row's text with its line feeds; of a row of over ``LONGEST`` lines, whose quote is never closed
    where it should be, the first ``LONGEST``.  ``skip`` leading lines of each file are left out."""
    lines = numbered(spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file")), "at", files=True)
    begins = lines.groupBy("file").agg(F.min("at").alias("first"))  # a row a file
    lines = lines.join(F.broadcast(begins), "file").select("file", (F.col("at") - F.col("first") + 1).alias("line"), "text").filter(F.col("line") > skip)
    quotes = F.length("text") - F.length(F.replace("text", F.lit(quote), F.lit(""))) if quote else F.lit(0)
    chunk = F.floor(F.col("line") / CHUNK).alias("chunk")
    in_chunk = Window.partitionBy("file", "chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("*", chunk, (quotes / (len(quote) or 1)).cast("long").alias("quotes")).withColumn("before", F.coalesce(F.sum("quotes").over(in_chunk), F.lit(0)) % 2)
    filled = F.length("text") > 0

    def of_parity(p: int) -> list[Column]:
        mine = F.col("before") == p
        return [F.max(F.when(mine, F.col("line"))).alias(f"last{p}"), F.count_if(mine & filled).alias(f"rows{p}")]

    chunks = lines.groupBy("file", "chunk").agg((F.sum("quotes") % 2).alias("odd"), *of_parity(0), *of_parity(1))
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    mine = lambda what: F.when(F.col("inside") == 0, F.col(f"{what}0")).otherwise(F.col(f"{what}1"))
    chunks = chunks.withColumn("carried", F.max(mine("last")).over(earlier)).withColumn("done", F.coalesce(F.sum(mine("rows")).over(earlier), F.lit(0)))
    both = lines.join(chunks.select("file", "chunk", "inside", "carried", "done"), ["file", "chunk"])
    begins_row = (F.col("before") + F.col("inside")) % 2 == 0
    up_to = Window.partitionBy("file", "chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("begins", begins_row).withColumn("start", F.coalesce(F.max(F.when(begins_row, F.col("line"))).over(up_to), F.col("carried")))
    both = both.withColumn("record", F.count_if(begins_row & filled).over(up_to) + F.col("done") - 1)
    whole = both.filter(F.col("begins") & (F.col("quotes") % 2 == 0) & filled)
    whole = whole.select("file", "line", "record", F.lit(1).cast("long").alias("lines"), F.col("text").alias("raw"), F.lit(False).alias("open"))
    pieces = both.filter(~(F.col("begins") & (F.col("quotes") % 2 == 0)))
    kept = F.when(F.col("line") - F.col("start") < LONGEST, F.struct("line", "text"))
    joined = pieces.groupBy("file", F.col("start").alias("line")).agg(
        F.min("record").alias("record"), F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"]), "\n").alias("raw"), (F.sum("quotes") % 2 == 1).alias("open")
    )
    return whole.unionByName(joined)


def read_strict(spark: SparkSession, path: str | list[str], delimiter: str = ",", quote: str = '"', skip: int = 0, expected: int | str | None = None, header_in: str | None = None, number: str | None = None) -> Strict:
    """rows: fitting rows under the header's names; set_aside: file, line, record (its number, from 1), width, problem and
    raw text of the others; widths: rows by width, those with an unclosed quote aside.

    ``expected``: a width, ``"modal"`` for the most frequent one, or the header's.  Empty and missing fields read as null
    and count towards the width where their delimiters are written.  A row with an unclosed quote is set aside.  Every
    file has a header of its own, of which the first file's names count; with ``header_in``, a folder, its files alone have
    one.  ``number``: a column of ``rows`` with the row's number in file order, set-aside rows counted."""
    found = text_rows(spark, path, quote, skip)
    bare = _unquoted(F.col("raw"), quote) if quote else F.col("raw")
    width = (F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))) / len(delimiter) + 1
    found = found.withColumn("width", width.cast("int"))
    first = F.col("record") == 0
    if header_in is not None:
        first &= F.contains("file", F.lit(header_in.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"))
    head = found.filter(first).orderBy("file").select("raw", "width").first()
    if head is None:
        raise ValueError(f"{path}: no header")
    # a quote that is never one: the option can't be empty
    options = {"sep": delimiter, "quote": quote or "\u0000", "escape": quote or "\u0000", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    fields = lambda n: "struct<" + ", ".join(f"f{i}: string" for i in range(n)) + ">"
    parsed = lambda n: F.from_csv("raw", F.lit(fields(n)), options)
    names = spark.createDataFrame([(head["raw"],)], "raw string").select(parsed(head["width"]).alias("f")).first()["f"]
    data = found.filter(~first)
    widths = data.filter(~F.col("open")).groupBy("width").agg(F.count("*").alias("n"))
    n = head["width"] if expected is None else (modal_width(widths) or head["width"]) if expected == "modal" else expected
    names = [*names, *[None] * n][:n]
    fits = (F.col("width") <= n) & ~F.col("open")
    from .load import short_header

    fitting, at = _numbers(data, True) if number else (data, F.lit(0))
    rows = fitting.filter(fits).select(parsed(n).alias("f"), at.alias("at")).select(*[F.col(f"f.f{i}").alias(c) for i, c in enumerate(short_header(names))], *([F.col("at").alias(number)] if number else []))
    problem = F.when(F.col("open"), OPEN).otherwise("more fields than expected" if expected else "more fields than the header")
    aside = data.filter(~fits).select("file", "line", "record", "width", problem.alias("problem"), "raw")
    return Strict(rows, aside, widths, n)


def _numbers(found: DataFrame, header: bool) -> tuple[DataFrame, Column]:
    """The rows with where their file's records begin, and a row's number over all files, from 1, in the files' order."""
    sizes = found.groupBy("file").agg((F.max("record") + (0 if header else 1)).alias("size"))  # a row a file
    before = F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("file", F.coalesce(before, F.lit(0)).alias("begins"))
    return found.join(F.broadcast(begins), "file"), F.col("begins") + F.col("record") + (0 if header else 1)


def read_kept(spark: SparkSession, path: str | list[str], delimiter: str = ",", quote: str = '"', skip: int = 0, header: bool = True, number: str | None = None) -> DataFrame:
    """All rows, with their ``number`` in file order if one is asked for, by the same splitting: a short row is filled up with nulls, a long one gives the table more columns, named
    by their number.  A row whose quote is never closed is refused, as rows behind it can't be told apart."""
    from .load import short_header

    found = text_rows(spark, path, quote, skip)
    bare = _unquoted(F.col("raw"), quote) if quote else F.col("raw")
    width = ((F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))) / len(delimiter) + 1).cast("int")
    seen = found.agg(F.max(width).alias("width"), F.min(F.when(F.col("open"), F.col("line"))).alias("open"), F.min_by("raw", F.when(F.col("record") == 0, F.col("file"))).alias("head")).first()
    if seen["width"] is None:
        raise ValueError(f"{path}: no rows")
    if seen["open"] is not None:
        raise ValueError(f"{path}: line {seen['open']} opens a quote that never closes, so the rows cannot be told apart")
    n = seen["width"]
    options = {"sep": delimiter, "quote": quote or "\u0000", "escape": quote or "\u0000", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    parsed = F.from_csv("raw", F.lit("struct<" + ", ".join(f"f{i}: string" for i in range(n)) + ">"), options)
    names = [""] * n
    if header:
        names = [*spark.createDataFrame([(seen["head"],)], "raw string").select(parsed.alias("f")).first()["f"]]
        found = found.filter("record > 0")
    found, at = _numbers(found, header) if number else (found, F.lit(0))
    return found.select(parsed.alias("f"), at.alias("at")).select(*[F.col(f"f.f{i}").alias(c) for i, c in enumerate(short_header(names))], *([F.col("at").alias(number)] if number else []))
