"""Observations about one table: duplicates, dependencies, correlation, outliers, shapes, raw checks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..written import settle
from .keys import SAMPLE, decides as score, distinct_counts, hashed_sample
from .profile import long_counts, quantiles


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each distinct row; nulls are equal."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def decides(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """column_name, decided: whether every group of x has one value of y, or only nulls; null x rows are a group."""
    aggs = [a for i, y in enumerate(ys) for a in (F.min(F.col(y).cast("string")).alias(f"a{i}"), F.max(F.col(y).cast("string")).alias(f"b{i}"), F.count(y).alias(f"n{i}"))]
    groups = df.groupBy(x).agg(F.count("*").alias("n"), *aggs)
    good = lambda i: (F.col(f"n{i}") == 0) | ((F.col(f"n{i}") == F.col("n")) & (F.col(f"a{i}") == F.col(f"b{i}")))
    row = groups.agg(*[F.coalesce(F.bool_and(good(i)), F.lit(True)).alias(f"g{i}") for i in range(len(ys))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(y).alias("column_name"), F.col(f"g{i}").alias("decided")) for i, y in enumerate(ys)])))


def dependencies(df: DataFrame, columns: Sequence[str], most: int | None = 40, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """(X, Y) for columns where X decides Y: each X goes with one value of Y, null a value of either.

    X has over one value and isn't (nearly) unique, Y over one and no more than X.  A sample refutes most pairs; columns
    that decide each other on all rows are one class, of which one stands for all; what is left is counted on all rows
    in one grouped pass.  ``most`` determinants are tried, those of the fewest values (None: all).  The driver holds
    column names and counts."""
    facts = {r["column_name"]: r for r in long_counts(df, columns).groupBy("column_name").agg(F.count("value").alias("d"), F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("filled")).collect()}
    live = [c for c in columns if c in facts and facts[c]["d"] > 1]
    able = sorted([c for c in live if facts[c]["d"] < 0.99 * facts[c]["filled"]], key=lambda c: (facts[c]["d"], columns.index(c)))[:most]
    pair = lambda x, y: tuple(sorted((x, y), key=columns.index))
    tried = [(x, y) for x in able for y in live if x != y and facts[y]["groups"] <= facts[x]["groups"]]
    if not tried:
        return []
    small = settle(hashed_sample(df.select(*columns), sample), "sample")
    seen = distinct_counts(small, [(c,) for c in able] + sorted({pair(*p) for p in tried}), nulls_apart=False)
    tried = [(x, y) for x, y in tried if seen[pair(x, y)] == seen[x,]]
    # one-to-one first: then a class is tried by its first column alone
    equal = sorted({pair(x, y) for x, y in tried if facts[x]["groups"] == facts[y]["groups"]})
    known = distinct_counts(df, equal, nulls_apart=False)
    first = {c: c for c in live}
    for x, y in equal:
        if known[x, y] == facts[x]["groups"]:
            first[y] = min(first[x], first[y], key=columns.index)
    rest = sorted({pair(first[x], first[y]) for x, y in tried if first[x] != first[y]} - set(equal))
    known |= distinct_counts(df, rest, nulls_apart=False)
    holds = lambda x, y: first[x] == first[y] or known.get(pair(first[x], first[y])) == facts[first[x]]["groups"]
    return [(x, y) for x, y in tried if holds(x, y)]


def dependency_matrix(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, str, float]]:
    """Scores of all ordered pairs; distinct counts of pairs come from one grouped pass, not from many distincts."""
    columns = list(columns)
    n = df.count()
    d = distinct_counts(df, [(c,) for c in columns] + list(combinations(columns, 2)), nulls_apart=False)
    return [(x, y, score(d[x,], d[y,], d[tuple(sorted((x, y), key=columns.index))], n)) for x in columns for y in columns if x != y and n]


def correlations(df: DataFrame, numbers: Sequence[str], least: float = 0.7) -> DataFrame:
    """a, b, r of pairs with |r| >= least.  Constant columns have no r.  One aggregate for all pairs."""
    pairs = list(combinations(numbers, 2))

    def r(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    row = df.agg(*[r(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    long = row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"r{i}"), 4).alias("r")) for i, (a, b) in enumerate(pairs)])))
    return long.filter(F.abs("r") >= least)


PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def outliers(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """For each number column: quantiles, fences at 1.5 interquartile ranges, rows outside, zeros, negatives, deviation.

    NaN, infinities and magnitudes from 1e150 on are counted apart.  Quantiles are exact, from counts of values
    in ranges, so that no task holds a column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in numbers]))).filter("x is not null")
    odd = F.isnan("x") | (F.abs("x") >= 1e150)
    counts = settle(long.groupBy("column_name", "x").agg(F.count("*").alias("n")), "counts")  # read several times
    fine = counts.filter(~odd)
    q = fine.groupBy("column_name").agg(
        F.sum("n").alias("filled"), F.min("x").alias("lowest"), F.max("x").alias("highest"),
        F.coalesce(F.sum(F.when(F.col("x") == 0, F.col("n"))), F.lit(0)).alias("zeros"), F.coalesce(F.sum(F.when(F.col("x") < 0, F.col("n"))), F.lit(0)).alias("negatives"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"),
    )
    q = q.join(F.broadcast(quantiles(fine, "column_name", [p / 100 for p in PERCENTS])), "column_name")  # a row for each column
    q = q.select("*", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate(PERCENTS)]).drop("q")
    q = q.withColumn("low_fence", F.col("p25") - 1.5 * (F.col("p75") - F.col("p25"))).withColumn("high_fence", F.col("p75") + 1.5 * (F.col("p75") - F.col("p25")))
    joined = fine.join(F.broadcast(q.select("column_name", "low_fence", "high_fence", "mean", "filled")), "column_name")
    beyond = joined.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("x") < F.col("low_fence"), F.col("n"))), F.lit(0)).alias("below"), F.coalesce(F.sum(F.when(F.col("x") > F.col("high_fence"), F.col("n"))), F.lit(0)).alias("above"),
        F.sqrt(F.try_divide(F.sum(F.col("n") * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))), F.first("filled") - 1)).alias("deviation"),
    )
    apart = counts.groupBy("column_name").agg(F.coalesce(F.sum(F.when(odd, F.col("n"))), F.lit(0)).alias("left_out"))
    return q.join(beyond, "column_name").join(apart, "column_name")


def date_outliers(df: DataFrame, dates: Sequence[str], today: str | None = None) -> DataFrame:
    """The same for dates and timestamps, as seconds since 1970 without a time zone, with first and last as text and the
    rows after ``today`` (by default the current date) and before 1900."""
    now = F.lit(today).cast("date") if today else F.current_date()

    def seconds(c: str) -> Column:
        d = F.col(c).cast("timestamp_ntz")
        return F.date_diff(d.cast("date"), F.lit("1970-01-01").cast("date")) * 86400.0 + F.hour(d) * 3600 + F.minute(d) * 60 + F.extract(F.lit("SECOND"), d).cast("double")

    out = outliers(df.select(*[seconds(c).alias(c) for c in dates]), dates).drop("lowest", "highest", "zeros", "negatives", "deviation", "left_out", "mean")
    entry = lambda c: F.struct(F.lit(c).alias("column_name"), F.col(c).cast("timestamp_ntz").alias("d"))
    ends = df.select(F.inline(F.array(*map(entry, dates)))).groupBy("column_name").agg(
        F.min("d").cast("string").alias("first"), F.max("d").cast("string").alias("last"), F.count_if(F.col("d").cast("date") > now).alias("future"), F.count_if(F.year("d") < 1900).alias("before_1900")
    )
    return out.join(F.broadcast(ends), "column_name")  # a row for each column


def shape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\\p{L}", "A"), "[0-9]", "9")


def shapes(df: DataFrame, columns: Sequence[str], top: int = 3) -> DataFrame:
    """The most frequent shapes of each column (letters A, digits 9), with their share of filled rows and an example.

    Shapes are taken of distinct values, which are far fewer than rows."""
    s = long_counts(df, columns).filter("value is not null").withColumn("shape", shape(F.col("value")))
    s = s.groupBy("column_name", "shape").agg(F.sum("n").alias("n"), F.min("value").alias("example"))
    by = Window.partitionBy("column_name")
    best = s.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "shape"))).filter(F.col("rank") <= top)
    totals = F.broadcast(s.groupBy("column_name").agg(F.sum("n").alias("total")))  # a row for each column
    return best.join(totals, "column_name").select(*s.columns, F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"), "rank")


def odd_shapes(df: DataFrame, columns: Sequence[str], least: float = 90, n: int = 3) -> DataFrame:
    """For columns of which one shape covers ``least`` percent of the filled rows, but not all: that shape, its percent,
    the rows of other shapes, the ``n`` least values among them and whether there are more."""
    v = long_counts(df, columns).filter("value is not null").withColumn("shape", shape(F.col("value")))
    sizes = v.groupBy("column_name", "shape").agg(F.sum("n").alias("n"))
    top = sizes.groupBy("column_name").agg(F.min_by("shape", F.struct((-F.col("n")).alias("m"), "shape")).alias("top"), F.max("n").alias("top_n"), F.sum("n").alias("total"))
    top = top.filter((F.col("top_n") < F.col("total")) & (100 * F.col("top_n") >= least * F.col("total")))  # a row for each column
    odd = v.join(F.broadcast(top), "column_name").filter(F.col("shape") != F.col("top"))
    odd = odd.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy("value"))).filter(F.col("rank") <= n + 1)  # cut before the exchange
    out = odd.groupBy("column_name", "top", "top_n", "total").agg(F.array_sort(F.collect_list("value")).alias("values"))
    percent = F.round(100.0 * F.col("top_n") / F.col("total"), 2)
    return out.select("column_name", F.col("top").alias("shape"), percent.alias("percent"), (F.col("total") - F.col("top_n")).alias("others"), F.slice("values", 1, n).alias("examples"), (F.size("values") > n).alias("more"))


def collapsed(shape_text: Column) -> Column:
    """Runs of A and 9 as A+ and 9+."""
    return F.regexp_replace(F.regexp_replace(shape_text, "A{2,}", "A+"), "9{2,}", "9+")


def raw_checks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each column: padded rows, distinct values that differ in case alone, rows with leading zeros."""
    c = long_counts(df, columns).filter("value is not null")
    folded = c.groupBy("column_name", F.lower("value").alias("low")).agg(F.count("*").alias("forms"), F.sum(F.when(F.col("value") != F.trim("value"), F.col("n"))).alias("padded"), F.sum(F.when(F.col("value").rlike("^0[0-9]+$"), F.col("n"))).alias("zeros"))
    return folded.groupBy("column_name").agg(F.coalesce(F.sum("padded"), F.lit(0)).alias("padded"), F.sum(F.col("forms") - 1).alias("case_variants"), F.coalesce(F.sum("zeros"), F.lit(0)).alias("leading_zeros"))


def worst_case_group(df: DataFrame, column: str) -> DataFrame:
    """The folded value with the most spellings: low, forms, n and its spellings, most frequent first."""
    v = df.select(F.col(column).cast("string").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    g = v.groupBy(F.lower("v").alias("low")).agg(F.count("*").alias("forms"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "v"))).alias("s"))
    return g.filter("forms > 1").orderBy(F.desc("forms"), F.desc("n"), "low").limit(1).select("low", "forms", "n", F.transform("s", lambda x: x["v"]).alias("spellings"))
