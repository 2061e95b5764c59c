"""Sources: where a side's rows come from.  Everything is read as text; row numbers are given at load."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field, replace
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import derived
from ..operators.match import numbered
from . import strict
from .guard import dialect_of, read_only
from .sheets import read_sheet

# Kinds by suffix.
KINDS = {"csv": "csv", "txt": "csv", "tsv": "csv", "dat": "csv", "parquet": "parquet", "pq": "parquet", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "xlsx": "sheet", "xlsm": "sheet", "xls": "sheet"}


def kind_of(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower().lstrip(".")
    if suffix not in KINDS:
        raise ValueError(f"{path}: no reader for .{suffix}; there are {', '.join(sorted(KINDS))}")
    return KINDS[suffix]


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text; binary as hexadecimal digits."""
    return df.select(*[(F.hex(c) if t == "binary" else F.to_json(c) if t.startswith(("struct", "array", "map")) else F.col(c).cast("string")).alias(c) for c, t in df.dtypes])


PARITY_BYTES = 256 << 20


def size_of(spark: SparkSession, path: str) -> int:
    """The bytes of a file or of a folder's files, in any store that Spark reads."""
    total = 0
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    for status in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []:
        total += status.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(status.getPath()).getLength()
    return total


@dataclass(frozen=True)
class Source:
    """A side: a path, table or query, read options, and the cut of rows (where, order, limit).

    ``multi_line``: quoted fields of a CSV file may hold line feeds.  Spark reads such a file in one task, so files of
    ``PARITY_BYTES`` or more, and those with ``skip_rows`` or ``bad_rows``, are split by the parity of their quotes, in many
    tasks.  ``bad_rows``: ``keep`` fills short rows and gives long ones more columns; ``set_aside`` leaves out rows that are
    wider than the header (:func:`strict.read_strict` has them).  ``jdbc`` takes Spark's own options; with ``partitionColumn``, its bounds and
    ``numPartitions`` the query is read by several tasks."""

    path: str | None = None
    kind: str | None = None
    delimiter: str = ","
    header: bool = True
    quote: str = '"'
    encoding: str = "UTF-8"
    null_values: tuple = ()
    where: str | None = None
    order_by: tuple = ()
    descending: bool = False
    limit: int | None = None
    names: dict = field(default_factory=dict)
    derived: dict = field(default_factory=dict)
    jdbc: dict = field(default_factory=dict)
    multi_line: bool = True
    query: str | None = None
    dialect: str | None = None
    skip_rows: int = 0
    bad_rows: str | None = None
    sheet: str = ""
    cells: str = ""
    stop_at_blank: bool = False

    @classmethod
    def from_config(cls, block: dict) -> "Source":
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in block.items() if k in cls.__dataclass_fields__}
        if unknown := set(block) - set(known):
            raise ValueError(f"unknown source settings: {', '.join(sorted(unknown))}")
        return cls(**known)

    def _by_parity(self, spark: SparkSession) -> bool:
        if self.query is not None or (self.kind or kind_of(self.path or "")) != "csv":
            return False
        if self.bad_rows not in (None, "keep", "set_aside"):
            raise ValueError(f"bad_rows={self.bad_rows!r} is neither keep nor set_aside")
        plain = self.encoding.upper() in ("UTF-8", "UTF8")
        return bool(self.skip_rows or self.bad_rows or self.multi_line and plain and size_of(spark, self.path) >= PARITY_BYTES)

    def _split_by_parity(self, spark: SparkSession, number: str | None) -> DataFrame:
        if self.bad_rows == "set_aside":
            return self._folded(strict.read_strict(spark, self.path, self.delimiter, self.quote, self.skip_rows, number=number).rows)
        return self._folded(strict.read_kept(spark, self.path, self.delimiter, self.quote, self.skip_rows, self.header, number))

    def read(self, spark: SparkSession) -> DataFrame:
        if self.query is not None:
            options = {"fetchsize": "50000"} | self.jdbc
            reader, query = spark.read.format("jdbc").options(**options), read_only(self.query, self.dialect or dialect_of(options.get("url", "")))
            # Spark takes a query with a partition column only as a derived table
            return as_text((reader.option("dbtable", f"({query}) q") if "partitionColumn" in options else reader.option("query", query)).load())
        kind = self.kind or kind_of(self.path or "")
        if kind == "table":
            return as_text(spark.table(self.path))
        if kind == "parquet":
            return as_text(spark.read.parquet(self.path))
        if kind in ("json", "jsonl"):
            return as_text(spark.read.option("primitivesAsString", True).option("multiLine", kind == "json").json(self.path))
        if kind == "sheet":
            return read_sheet(spark, self.path, sheet=self.sheet, range=self.cells, header=self.header, stopatblank=self.stop_at_blank)
        if self._by_parity(spark):
            return self._split_by_parity(spark, None)
        reader = spark.read.option("header", self.header).option("sep", self.delimiter).option("quote", self.quote).option("escape", self.quote).option("encoding", self.encoding)
        df = reader.option("multiLine", self.multi_line).option("inferSchema", False).option("enforceSchema", True).csv(self.path)
        return self._folded(df)

    def _folded(self, df: DataFrame) -> DataFrame:
        fold = lambda c: F.when(~F.col(c).isin(*self.null_values), F.col(c)).alias(c)
        return df.select(*[fold(c) if t == "string" else F.col(c) for c, t in df.dtypes]) if self.null_values else df

    def cut(self, df: DataFrame) -> DataFrame:
        """Renamed and derived columns, then the row cut.  A derived column is a Spark SQL expression, in which ``;`` is
        refused, or a pair of a ready-made name (``values.DERIVED``) and a column."""
        for old, new in self.names.items():
            df = df.withColumnRenamed(old, new)
        for name, expression in self.derived.items():
            if not isinstance(expression, str):
                df = df.withColumn(name, derived(expression[0], F.col(expression[1])))
                continue
            if ";" in expression:
                raise ValueError("an expression can't hold ';'")
            df = df.withColumn(name, F.expr(expression).cast("string"))
        if self.where:
            if ";" in self.where:
                raise ValueError("a filter can't hold ';'")
            df = df.filter(F.expr(self.where))
        if self.order_by:
            df = df.orderBy(*[F.desc_nulls_last(c) if self.descending else F.asc_nulls_last(c) for c in self.order_by])
        return df.limit(self.limit) if self.limit else df

    def load(self, spark: SparkSession, number: bool = False) -> DataFrame:
        """``number``: add __rn__, the row's number in file order, before the cut."""
        if number and self._by_parity(spark):
            return self.cut(self._split_by_parity(spark, "__rn__"))
        df = self.read(spark)
        return self.cut(numbered(df, files=self.query is None and (self.kind or kind_of(self.path or "")) not in ("table", "sheet")) if number else df)

    def set_aside(self, spark: SparkSession) -> DataFrame | None:
        """The rows that ``bad_rows="set_aside"`` leaves out: file, line, record, width, problem, raw; else None."""
        return strict.read_strict(spark, self.path, self.delimiter, self.quote, self.skip_rows).set_aside if self.bad_rows == "set_aside" else None

    def with_cut(self, **changes) -> "Source":
        return replace(self, **changes)


def short_header(columns: list[str]) -> list[str]:
    """Names that are empty or repeated get a number."""
    out: list[str] = []
    for i, c in enumerate(columns, 1):
        name = (c or "").strip() or f"column{i}"
        k, base = 2, name
        while name.lower() in {x.lower() for x in out}:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def looks_headerless(columns: list[str]) -> bool:
    """Whether most names read as values: numbers, dates or nothing."""
    import re

    odd = sum(not c or bool(re.fullmatch(r"[-+0-9.,/: ]+", c)) for c in columns)
    return bool(columns) and odd * 2 > len(columns)


def pair_folders(left: list[str], right: list[str], pattern: str = "*") -> tuple[list[tuple[str, str]], list[str], list[str]]:
    """Files of equal name, whatever their case; then the files of either side without a counterpart."""
    name = lambda p: PurePosixPath(p).name.lower()
    keep = lambda paths: {name(p): p for p in sorted(paths) if fnmatch.fnmatch(name(p), pattern.lower()) and not name(p).startswith((".", "~$"))}
    a, b = keep(left), keep(right)
    return [(a[n], b[n]) for n in a if n in b], [a[n] for n in a if n not in b], [b[n] for n in b if n not in a]


def distinct_values(df: DataFrame, column: str, search: str = "", n: int = 50) -> DataFrame:
    """value, n: the most frequent values that hold ``search``, in any case; null last among equals."""
    v = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    if search:
        v = v.filter(F.lower("value").contains(search.lower()))
    return v.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n)
