"""Follow-up questions to a comparison: buckets, value pairs, value counts, near matches, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import to_double
from ..written import settle
from .diff import BUCKET, Options, with_differences, within
from .keys import key_number
from .match import LEFT, OCC, RIGHT, occurrences
from .profile import quantiles

BUCKETS = ("matched", "same", "differ", "left", "right")


def bucket(matched: DataFrame, name: str, columns: Sequence[str], options: Options = Options()) -> DataFrame:
    """Rows of a bucket, with ``diffs``.  ``same`` and ``differ`` part ``matched``."""
    if name not in BUCKETS:
        raise ValueError(f"bucket {name!r} is none of {', '.join(BUCKETS)}")
    d = with_differences(within(matched, *(("same", "differ") if name in ("matched", "same", "differ") else (name,))), columns, options)
    l, r = F.col(LEFT).isNotNull(), F.col(RIGHT).isNotNull()
    where = {"matched": l & r, "same": l & r & (F.size("diffs") == 0), "differ": F.size("diffs") > 0, "left": l & ~r, "right": r & ~l}
    return d.filter(where[name])


def bucket_rows(matched: DataFrame, name: str, keys: Sequence[str], columns: Sequence[str], options: Options = Options()) -> DataFrame:
    """A bucket's rows laid out flat, for any measure of one table: keys once, a column of both sides as a_<column> and
    b_<column>, a column that one side has as a_<column> or b_<column> alone; one-sided rows under their own names."""
    fields = {side: matched.schema[side].dataType.fieldNames() for side in (LEFT, RIGHT)}
    rows = bucket(matched, name, [c for c in columns if c in fields[LEFT] and c in fields[RIGHT]], options)
    if name in ("left", "right"):
        side = LEFT if name == "left" else RIGHT
        return rows.select(*keys, *[F.col(f"{side}.{c}").alias(c) for c in columns if c not in keys and c in fields[side]])
    return rows.select(*keys, *[F.col(f"{side}.{c}").alias(f"{prefix}_{c}") for c in columns if c not in keys for side, prefix in ((LEFT, "a"), (RIGHT, "b")) if c in fields[side]])


def key_compare(matched: DataFrame, key: str) -> DataFrame:
    """A row a side (A, B): its rows, those matched, those without a partner, of these the filled keys and the lowest and
    highest key, by the last run of digits or, where no such key has one, as text.  One pass; an empty side gives zeros."""
    v = F.col(key).cast("string")
    rows = matched.select(F.col(LEFT).isNotNull().alias("l"), F.col(RIGHT).isNotNull().alias("r"), v.alias("v"), key_number(v).alias("x"))

    def side(name: str, here: Column, there: Column) -> Column:
        only = here & ~there
        end = lambda f: F.coalesce(f(F.when(only, F.col("x")))["v"], f(F.when(only, F.col("v"))))
        return F.struct(F.lit(name).alias("side"), F.count_if(here).alias("rows"), F.count_if(here & there).alias("matched"), F.count_if(only).alias("only"), F.count(F.when(only, F.col("v"))).alias("filled"), end(F.min).alias("lowest"), end(F.max).alias("highest"))

    l, r = F.col("l"), F.col("r")
    return rows.agg(F.array(side("A", l, r), side("B", r, l)).alias("sides")).select(F.inline("sides"))


def frequencies(df: DataFrame, value: Column, n: int, least: bool = False) -> DataFrame:
    """value, n, percent of all rows: the n most (or least) frequent values; ties by value; null is a value."""
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    some = counts.orderBy(F.asc("n") if least else F.desc("n"), F.asc_nulls_last("value")).limit(n)
    total = F.broadcast(df.agg(F.count("*").alias("total")))  # one row
    return some.join(total, how="cross").select("value", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))


def value_pairs(cell_rows: DataFrame, n: int = 10) -> DataFrame:
    """For each differing column its n most frequent pairs of values, with their share of the column's differences."""
    pairs = cell_rows.groupBy("column_name", "left_value", "right_value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("column_name")
    order = by.orderBy(F.desc("n"), F.asc_nulls_last("left_value"), F.asc_nulls_last("right_value"))
    top = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)  # cut to n before the exchange
    totals = F.broadcast(pairs.groupBy("column_name").agg(F.sum("n").alias("total")))  # a row for each column
    return top.join(totals, "column_name").select(*pairs.columns, F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"), "rank")


def by_key_value(matched: DataFrame, key: str, columns: Sequence[str], options: Options = Options()) -> DataFrame:
    """For each value of a key column: matched rows, differing rows, their share, cells, and the columns that differ."""
    d = bucket(matched, "matched", columns, options)
    out = d.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("matched"), F.count_if(F.size("diffs") > 0).alias("diff_rows"), F.sum(F.size("diffs")).cast("long").alias("cells"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("diffs")))), ",").alias("columns"))
    return out.filter("diff_rows > 0").withColumn("percent", F.round(100.0 * F.col("diff_rows") / F.col("matched"), 2))


def value_counts(matched: DataFrame, column: str, side: str = "both", filled_only: bool = False) -> DataFrame:
    """value, left_n, right_n, rank and running total, the most frequent first, ties by value with null last.

    ``side``: ``left``, ``right``, ``both``, or ``pair`` for pairs of values in matched rows."""
    l, r = F.col(f"{LEFT}.{column}"), F.col(f"{RIGHT}.{column}")
    if side == "pair":
        rows = matched.filter(F.col(LEFT).isNotNull() & F.col(RIGHT).isNotNull()).groupBy(l.alias("value"), r.alias("right_value")).agg(F.count("*").alias("n"))
        if filled_only:
            rows = rows.filter("value is not null and right_value is not null")
        order = ["value", "right_value"]
    else:
        sides = [F.struct(l.alias("value"), F.lit(1).alias("a"), F.lit(0).alias("b"), F.col(LEFT).isNotNull().alias("there"))] * (side in ("left", "both"))
        sides += [F.struct(r.alias("value"), F.lit(0).alias("a"), F.lit(1).alias("b"), F.col(RIGHT).isNotNull().alias("there"))] * (side in ("right", "both"))
        rows = matched.select(F.inline(F.array(*sides))).filter("there").groupBy("value").agg(F.sum("a").alias("left_n"), F.sum("b").alias("right_n"))
        rows = rows.withColumn("n", F.col("left_n") + F.col("right_n"))
        if filled_only:
            rows = rows.filter("value is not null")
        order = ["value"]
    return ranked(rows, order)


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds rank and running total by ``n``, the greatest first, ties by ``order`` with null last.

    ``rows`` are written first, so that what they come from runs once.  Values of one count are numbered by
    :func:`occurrences`, which splits large groups; where each count begins follows from a table of counts, of which N
    rows have under 2 * sqrt(N) different ones."""
    rows = settle(rows, "counts")
    nulls = [f"__null{i}" for i in range(len(order))]
    marked = rows.withColumns({m: F.col(c).isNull() for m, c in zip(nulls, order)})
    own = occurrences(marked, ["n"], [x for pair in zip(nulls, order) for x in pair], "__own")
    before = Window.orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(F.col("n").alias("m")).agg(F.count("*").alias("k"))
    starts = starts.select("m", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum(F.col("m") * F.col("k")).over(before), F.lit(0)).alias("sum_before"))
    out = own.join(starts, F.col("n") == F.col("m"))
    return out.select(*rows.columns, (F.col("rows_before") + F.col("__own")).cast("int").alias("rank"), (F.col("sum_before") + F.col("__own") * F.col("n")).alias("running"))


def search(counts: DataFrame, text: str) -> DataFrame:
    return counts.filter(F.lower(F.col("value")).contains(text.lower()))


def page(df: DataFrame, order: Sequence, offset: int, n: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n)


def near_match(cell_rows: DataFrame) -> DataFrame:
    """For each column: mismatches, mean edit distance and similarity in percent; cells null on both sides are left out."""
    a, b = F.coalesce("left_value", F.lit("")), F.coalesce("right_value", F.lit(""))
    d = cell_rows.filter("left_value is not null or right_value is not null").select("column_name", F.levenshtein(a, b).alias("d"), F.greatest(F.length(a), F.length(b), F.lit(1)).alias("n"))
    return d.groupBy("column_name").agg(F.count("*").alias("mismatches"), F.round(F.avg("d"), 4).alias("mean_distance"), F.round(100 * F.avg(1 - F.least(F.lit(1.0), F.col("d") / F.col("n"))), 2).alias("similarity"))


def one_sided_columns(matched: DataFrame, side: str, columns: Sequence[str]) -> DataFrame:
    """rows, filled, distinct of each column over the rows of one side alone; constant where distinct is 1 throughout."""
    rows = matched.filter(F.col(RIGHT if side == LEFT else LEFT).isNull())
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{side}.{c}").cast("string").alias("v")) for c in columns])))
    counts = long.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("column_name").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"), F.count("v").alias("distinct_values"), ((F.count("v") == 1) & (F.count("*") == 1)).alias("constant"))


def ledger(matched: DataFrame, columns: Sequence[str], options: Options = Options()) -> DataFrame:
    """For each compared column: matched, mismatched, match percent.  One aggregate over the pairs for all columns."""
    pairs = with_differences(within(matched, "same", "differ"), columns, options).filter(F.col(LEFT).isNotNull() & F.col(RIGHT).isNotNull())
    row = pairs.agg(F.count("*").alias("matched"), *[F.count_if(F.array_contains("diffs", c)).alias(f"n{i}") for i, c in enumerate(columns)])
    out = row.select("matched", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("mismatched")) for i, c in enumerate(columns)])))
    return out.select("column_name", "mismatched", "matched", F.round(F.try_divide(100.0 * (F.col("matched") - F.col("mismatched")), F.col("matched")), 2).alias("match_percent"))


def differing_rows(matched: DataFrame, columns: Sequence[str], options: Options = Options()) -> DataFrame:
    """Differing pairs with the number of their differing cells, for pages that show the worst first."""
    return bucket(matched, "differ", columns, options).withColumn("n", F.size("diffs"))


def paired_rows(matched: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pairs side by side: keys, then a_ and b_ columns."""
    both = matched.filter(F.col(LEFT).isNotNull() & F.col(RIGHT).isNotNull())
    return both.select(*keys, OCC, *[F.col(f"{s}.{c}").alias(f"{p}{c}") for c in columns for s, p in ((LEFT, "a_"), (RIGHT, "b_"))])


def report_rows(matched: DataFrame, order: Sequence, n: int | None = 1000) -> DataFrame:
    """Differing pairs with both sides' whole rows and the names of the columns that differ, in ``order`` (columns of the
    match, as l.__rn__ for file order), ``n`` of them: what a report lists.  None: all."""
    rows = within(matched, "differ").filter(F.size("diffs") > 0).select(*[c for c in matched.columns if c not in (LEFT, RIGHT, "diffs", BUCKET)], LEFT, RIGHT, F.array_join(F.array_sort("diffs"), ",").alias("marks")).orderBy(*order)
    return rows if n is None else rows.limit(n)


def above_below(matched: DataFrame, keys: Sequence[str], columns: Sequence[str], options: Options = Options()) -> DataFrame:
    """Differing pairs as two rows, A above B: keys, occurrence, side, columns, and ``marks``, the columns that differ."""
    row = lambda tag, side: F.struct(F.lit(tag).alias("side"), *[F.col(f"{side}.{c}").alias(c) for c in columns])
    return bucket(matched, "differ", columns, options).select(*keys, OCC, F.col("diffs").alias("marks"), F.inline(F.array(row("A", LEFT), row("B", RIGHT))))


def unmatched_samples(matched: DataFrame, keys: Sequence[str], n: int = 3, least: float = 0.9) -> DataFrame:
    """side, key: the ``n`` least unmatched keys of either side where under ``least`` of the smaller side's rows match,
    which mostly means that the sides write their keys differently; otherwise no row."""
    l, r = F.col(LEFT).isNotNull(), F.col(RIGHT).isNotNull()
    size = matched.agg(F.count_if(l & r).alias("both"), F.least(F.count_if(l), F.count_if(r)).alias("floor"))
    poor = F.broadcast(size.filter((F.col("floor") > 0) & (F.col("both") < least * F.col("floor"))))  # one row at most
    text = F.concat_ws(" | ", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys])
    some = lambda side, rows: rows.select(F.lit(side).alias("side"), text.alias("key")).orderBy("key").limit(n)
    return some("left", matched.filter(l & ~r)).union(some("right", matched.filter(r & ~l))).join(poor, how="cross").select("side", "key")


def case_probe(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, exact, folded, ignore_case: the shares of the smaller side's distinct values that the other side
    has, as written and in upper case; case is to be ignored where folding lifts the share by 0.3 or more to 0.8 or more.
    Columns with under 5 distinct values on a side are left out.  All values count, not a sample."""
    tagged = lambda df, tag: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])), F.lit(tag).alias("side"))
    v = tagged(left, 1).union(tagged(right, 2)).filter("v is not null").groupBy("column_name", "v").agg(F.min("side").alias("a"), F.max("side").alias("b"))
    up = v.groupBy("column_name", F.upper("v").alias("u")).agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.count_if(F.col("a") == 1).alias("l"), F.count_if(F.col("b") == 2).alias("r"), F.count_if(F.col("a") < F.col("b")).alias("both")
    )
    one, two = F.col("a") == 1, F.col("b") == 2
    c = up.groupBy("column_name").agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.sum("both").alias("both"), F.count_if(one).alias("ul"), F.count_if(two).alias("ur"), F.count_if(one & two).alias("ub"))
    exact, folded = F.col("both") / F.least("l", "r"), F.col("ub") / F.least("ul", "ur")
    c = c.filter(F.least("l", "r") >= 5)
    return c.select("column_name", F.round(exact, 4).alias("exact"), F.round(folded, 4).alias("folded"), ((folded >= 0.8) & (folded - exact >= 0.3)).alias("ignore_case"))


def _side_numbers(matched: DataFrame, column: str) -> DataFrame:
    """side, x, n: the finite numbers of a column on either side, counted."""
    x = lambda side: F.struct(F.lit(side).alias("side"), to_double(F.col(f"{side}.{column}").cast("string")).alias("x"))
    long = matched.select(F.inline(F.array(x(LEFT), x(RIGHT)))).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    return long.groupBy("side", "x").agg(F.count("*").alias("n"))


def side_histogram(matched: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """side, bin, low, high, n: bins of equal width over each side's numbers, the last one closed."""
    counts = _side_numbers(matched, column)
    ends = counts.groupBy("side").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # two rows at most
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(bins - 1)))
    out = counts.join(F.broadcast(ends), "side").groupBy("side", at.cast("int").alias("bin"), "lo", "hi").agg(F.sum("n").alias("n"))
    high = F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width)
    return out.select("side", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), high.alias("high"), "n")


def medians(matched: DataFrame, column: str) -> DataFrame:
    """side, filled, median of a number column over each side's rows; values are counted first, so it is exact."""
    counts = _side_numbers(matched, column)
    filled = counts.groupBy("side").agg(F.sum("n").alias("filled"))
    return filled.join(F.broadcast(quantiles(counts, "side", [0.5])), "side").select("side", "filled", F.round(F.col("q")[0], 6).alias("median"))  # two rows
