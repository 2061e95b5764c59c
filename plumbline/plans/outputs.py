"""Written results of a comparison: Parquet tables, one-file CSVs and summaries."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import diff, profile, readback


def percent_text(part: int, whole: int) -> str:
    """Two decimals, but never 0 or 100 for a proper fraction; up to six decimals."""
    if not whole:
        return ""
    value = 100 * part / whole
    for places in range(2, 7):
        text = f"{value:.{places}f}"
        if part in (0, whole) or 0 < float(text) < 100:
            return text
    return text


def write_table(df: DataFrame, path: str) -> None:
    """As Parquet, and from that as CSV, so that nothing is worked out twice."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.sparkSession.read.parquet(f"{path}.parquet").write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_json(spark: SparkSession, value: dict | list, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


@dataclass
class Counts:
    """A comparison of rows as a multiset: columns, left_count and right_count."""

    rows: DataFrame

    def summary(self) -> dict:
        lacks = lambda a, b: F.coalesce(F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0))), F.lit(0))
        same = F.coalesce(F.sum(F.least("left_count", "right_count")), F.lit(0))
        row = self.rows.agg(same.alias("matched"), lacks("left_count", "right_count").alias("only_left"), lacks("right_count", "left_count").alias("only_right")).first().asDict()
        return {"schema_version": 1, "verdict": diff.verdict(**row, diff_rows=0), **row, "diff_rows": 0, "cell_diffs": 0}

    def write(self, folder: str) -> dict:
        write_table(self.rows.filter("left_count <> right_count"), f"{folder}/row_count_diffs")
        out = self.summary()
        write_json(self.rows.sparkSession, out, f"{folder}/summary.json")
        return out


@dataclass
class Result:
    matched: DataFrame
    keys: list[str]
    columns: list[str]
    options: diff.Options = diff.Options()
    only_left_columns: tuple[str, ...] = ()
    only_right_columns: tuple[str, ...] = ()
    profiled: bool = False

    def settled(self) -> "Result":
        """The same over a written match, which every follow-up then reads."""
        return self if diff.BUCKET in self.matched.columns else replace(self, matched=diff.snapshot(self.matched, self.columns, self.options))

    def summary(self) -> dict:
        row = diff.summary(self.matched, self.columns, self.options).first().asDict()
        verdict = diff.verdict(row["matched"], row["only_left"], row["only_right"], row["diff_rows"], len(self.only_left_columns) + len(self.only_right_columns))
        return {"schema_version": 1, "verdict": verdict, **row, "columns_only_left": list(self.only_left_columns), "columns_only_right": list(self.only_right_columns), "diff_percent": percent_text(row["diff_rows"], row["matched"])}

    def ledger(self) -> DataFrame:
        """A row for each column: its role (compared, key, only_left, only_right), matched and mismatched pairs."""
        spark = self.matched.sparkSession
        found = readback.ledger(self.matched, self.columns, self.options)
        others = [(c, role) for role, cs in (("key", self.keys), ("only_left", self.only_left_columns), ("only_right", self.only_right_columns)) for c in cs]
        return found.withColumn("role", F.lit("compared")).unionByName(spark.createDataFrame(others, "column_name string, role string"), allowMissingColumns=True)

    def profile(self) -> DataFrame:
        """Statistics of the compared columns, a row a column and side (l, r), of all rows that the match holds."""
        sides = [profile.statistics(self.matched.filter(F.col(s).isNotNull()).select(f"{s}.*").select(*self.columns), self.columns).select(F.lit(s).alias("side"), "*") for s in ("l", "r")]
        return sides[0].unionByName(sides[1])

    def write(self, folder: str) -> dict:
        """cells, left_only, right_only, paired rows, columns and, with ``profiled``, profile as Parquet and CSV, and summary
        as JSON text; returns the summary.  The sides are matched once: all of it is read from the written match."""
        self, m = (done := self.settled()), done.matched
        paired = readback.paired_rows(diff.within(m, "differ"), self.keys, self.columns)
        tables = {"cell_diffs": diff.cells(m, self.keys, self.columns, self.options, occurrence=True), "left_only": diff.one_sided(m, "l"), "right_only": diff.one_sided(m, "r"), "paired_rows": paired, "columns": self.ledger()}
        if self.profiled and self.columns:
            tables["profile"] = self.profile()
        for name, df in tables.items():
            write_table(df, f"{folder}/{name}")
        out = self.summary()
        write_json(self.matched.sparkSession, out, f"{folder}/summary.json")
        return out


def roll_up(spark: SparkSession, results: list[dict], folder: str) -> None:
    """The summaries of all pairs, as JSON text and as a CSV table."""
    write_json(spark, results, f"{folder}/summary.json")
    flat = [{k: "|".join(v) if isinstance(v, list) else v for k, v in r.items()} for r in results]
    names = list(dict.fromkeys(k for r in flat for k in r))
    rows = [tuple(None if r.get(k) is None else str(r[k]) for k in names) for r in flat]
    spark.createDataFrame(rows, ", ".join(f"{k} string" for k in names)).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/summary.csv")


def exit_code(results: list[dict], unpaired_files: int = 0, errors: int = 0) -> int:
    if errors:
        return 2
    return int(bool(unpaired_files) or any(r["verdict"] != "Identical" for r in results))
