"""The overview of one table: what stands out, as rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import keys, observe, profile, spelling

NEAR = 5000  # different values from which a column is free text rather than names that are spelled in several ways
PAIRS = 5


def _rows(df: DataFrame, finding: str, column, value, n) -> DataFrame:
    return df.select(F.lit(finding).alias("finding"), column.alias("column_name"), value.cast("string").alias("value"), n.cast("double").alias("n"))


def overview(df: DataFrame, texts: Sequence[str] = (), times: Sequence[str] = (), numbers: Sequence[str] = (), key: str | None = None, near: int | None = NEAR) -> DataFrame:
    """finding, column_name, value, n:

    ``placeholder``: a word that stands for nothing, and its rows; ``spelled several ways``: the most frequent spelling of
    a group, and the group's forms (in columns of up to ``near`` different values; None: in all); ``gap``: missing numbers
    of the key as "from - to", the largest first; ``one value past the gap``: a column with one value on all rows past the
    largest run of keys; ``weekend``, ``placeholder day``, ``future``, ``before 1900``: rows of a time column; ``outliers``:
    rows outside a number column's fences; ``duplicates``: rows beyond the first of each; ``pair``: the ``PAIRS`` strongest
    dependencies "decides column", in percent beyond chance."""
    none, out = F.lit(None), []
    if texts:
        found = spelling.placeholders(df, list(texts))
        out.append(_rows(found, "placeholder", F.col("column_name"), F.col("word"), F.col("n")))
        sizes = {r["column_name"]: r["d"] for r in profile.long_counts(df, texts).groupBy("column_name").agg(F.count("value").alias("d")).collect()}
        for c in texts:
            if near is None or sizes.get(c, 0) <= near:
                out.append(_rows(spelling.fingerprint_groups(df, c), "spelled several ways", F.lit(c), F.col("top"), F.col("forms")))
    if key:
        number = F.col(key)
        gap = F.concat_ws(" - ", "low", "high")
        out.append(_rows(keys.gaps(df, number), "gap", F.lit(key), gap, F.col("size")))
        others = [c for c in df.columns if c != key]
        past = keys.beyond_largest_run(df, number, others).filter("rows_past > 0 and distinct_past = 1 and distinct_all > 1")
        out.append(_rows(past, "one value past the gap", F.col("column_name"), none, F.col("rows_past")))
    for c in times:
        facts = profile.time_facts(df, F.col(c))
        kinds = {"weekend": "weekend", "placeholder day": "placeholders", "future": "future", "before 1900": "before_1900"}
        long = facts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("finding"), F.col(v).cast("double").alias("n")) for k, v in kinds.items()]))).filter("n > 0")
        out.append(long.select("finding", F.lit(c).alias("column_name"), none.cast("string").alias("value"), "n"))
    if numbers:
        beyond = observe.outliers(df, numbers).withColumn("n", F.col("below") + F.col("above")).filter("n > 0")
        out.append(_rows(beyond, "outliers", F.col("column_name"), none, F.col("n")))
    out.append(_rows(observe.duplicate_rows(df).filter("duplicates > 0"), "duplicates", none.cast("string"), none, F.col("duplicates")))
    deciding = [c for c in (*texts, *times, *numbers) if c != key]
    strongest = sorted((p for p in observe.dependency_matrix(df, deciding) if p[2] > 0), key=lambda p: (-p[2], p[0], p[1]))[:PAIRS]
    out.append(df.sparkSession.createDataFrame([("pair", y, x, float(v)) for x, y, v in strongest], "finding string, column_name string, value string, n double"))
    return reduce(DataFrame.unionByName, out)
