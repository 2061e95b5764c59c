"""One table's columns: statistics, frequencies, histograms, parts, number and time forms, flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..written import settle
from .match import size_estimate

PLACEHOLDER_DAYS = ("1900-01-01", "1970-01-01", "9999-12-31", "0001-01-01")  # fixed values


def long_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, value, n: one pass and one exchange serve distinct counts, nulls and frequencies of all columns."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])))
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def statistics(df: DataFrame, columns: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """For each column: rows, nulls, distinct values, their shares, least and greatest value and lengths.

    Columns in ``numbers`` have numeric bounds and a mean; the others have those of their texts."""
    c, v, n = long_counts(df, columns), F.col("value"), F.col("n")
    num = F.when(F.col("column_name").isin(list(numbers)), v.try_cast("double")) if numbers else F.lit(None).cast("double")
    filled = F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0))
    out = c.groupBy("column_name").agg(
        F.sum("n").alias("rows"), filled.alias("filled"), F.count("value").alias("distinct_values"), F.min(v).alias("min_text"), F.max(v).alias("max_text"), F.min(num).alias("min_number"), F.max(num).alias("max_number"),
        F.round(F.try_divide(F.sum(num * n), F.sum(F.when(num.isNotNull(), n))), 4).alias("mean"), F.min(F.length(v)).alias("min_length"), F.max(F.length(v)).alias("max_length"),
        F.round(F.try_divide(F.sum(F.length(v) * n), filled), 4).alias("mean_length"),
    )
    out = out.withColumn("nulls", F.col("rows") - F.col("filled")).withColumn("null_percent", F.round(100.0 * F.col("nulls") / F.col("rows"), 2))
    return out.withColumn("distinct_percent", F.round(F.try_divide(100.0 * F.col("distinct_values"), F.col("filled")), 2))


def top_values(df: DataFrame, columns: Sequence[str], n: int = 10, least: bool = False) -> DataFrame:
    """For each column its n most (least) frequent values, ties by value, null a value, with percent of all rows."""
    by = Window.partitionBy("column_name")
    rank = F.row_number().over(by.orderBy(F.asc("n") if least else F.desc("n"), F.asc_nulls_last("value")))
    counts = long_counts(df, columns)
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= n)  # cut to n before the exchange
    total = F.broadcast(df.agg(F.count("*").alias("total")))  # one row
    return top.join(total, how="cross").select(*counts.columns, F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"), "rank")


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For columns that one side alone has: rows, filled, distinct values, the most frequent value (the least among
    equals, null none) and shares of all rows."""
    n, there = F.col("n"), F.col("value").isNotNull()
    c = long_counts(df, columns).groupBy("column_name").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(there, n)), F.lit(0)).alias("filled"), F.count("value").alias("distinct_values"),
        F.min_by("value", F.when(there, F.struct((-n).alias("m"), "value"))).alias("top"), F.max(F.when(there, n)).alias("top_n"),
    )
    percent = lambda x: F.round(100.0 * F.coalesce(x, F.lit(0)) / F.col("rows"), 2)
    return c.select("column_name", "rows", "filled", percent(F.col("filled")).alias("filled_percent"), "distinct_values", "top", percent(F.col("top_n")).alias("top_percent"))


def both_sides(left: DataFrame, right: DataFrame, columns: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """For each paired column the shares of nulls and their gap, distinct values and bounds on either side."""
    facts = ("null_percent", "distinct_values", *(f"{b}_{k}" for k in ("text", "number") for b in ("min", "max")))
    side = lambda df, tag: statistics(df, columns, numbers).select("column_name", *[F.col(f).alias(f"{tag}_{f}") for f in facts])
    both = side(left, "left").join(F.broadcast(side(right, "right")), "column_name")  # a row for each column
    return both.withColumn("null_gap", F.round(F.abs(F.col("left_null_percent") - F.col("right_null_percent")), 2))


def side_notes(both: DataFrame) -> DataFrame:
    """What stands out between the sides of :func:`both_sides`: column_name, note, left_n and right_n (distinct values).

    empty: null throughout on both; constant: one value at most on either, no key; unlike: one side has over twice the
    distinct values of the other, so that it may be spelled differently or be another field."""
    l, r = F.col("left_distinct_values"), F.col("right_distinct_values")
    found = F.when((l == 0) & (r == 0), "empty").when((l <= 1) & (r <= 1), "constant").when(F.greatest(l, r) > 2 * F.greatest(F.least(l, r), F.lit(1)), "unlike")
    return both.select("column_name", found.alias("note"), l.alias("left_n"), r.alias("right_n")).filter("note is not null")


def histogram(df: DataFrame, value: Column, bins: int = 20) -> DataFrame:
    """bin, low, high, n over equal widths, the last bin closed; values that aren't finite are left out."""
    x = df.select(value.cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(bins - 1)))
    out = x.join(F.broadcast(ends), how="cross").groupBy(at.cast("int").alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    return out.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def digits_before(x: Column) -> Column:
    """Digits before the point: 0 for numbers under 1."""
    whole = F.floor(F.abs(x))
    return F.when(whole < 1, 0).otherwise(F.length(whole.cast("decimal(38,0)").cast("string")))


def digit_band(n: Column, top: int = 16) -> Column:
    low = F.floor((n - 1) / 3) * 3 + 1
    return F.when(n == 0, "0").when(n >= top, F.lit(f"{top}+")).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 2).cast("string")))


def number_parts(df: DataFrame, value: Column) -> DataFrame:
    x = df.select(value.cast("double").alias("x")).filter("x is not null")
    return x.groupBy(digit_band(digits_before(F.col("x"))).alias("band")).agg(F.count("*").alias("n"))


def date_parts(df: DataFrame, value: Column) -> DataFrame:
    """part (year, month, weekday from Monday = 1, hour), value, n."""
    d = df.select(value.alias("d")).filter("d is not null")
    parts = {"year": F.year("d"), "month": F.month("d"), "weekday": F.weekday("d") + 1, "hour": F.hour("d")}
    long = d.select(F.inline(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("value")) for k, v in parts.items()])))
    return long.groupBy("part", "value").agg(F.count("*").alias("n"))


def text_parts(df: DataFrame, value: Column, n: int = 2) -> DataFrame:
    """part (first, last), the first or last n characters, n."""
    t = df.select(value.alias("t")).filter("t is not null")
    long = t.select(F.inline(F.array(F.struct(F.lit("first").alias("part"), F.left("t", F.lit(n)).alias("value")), F.struct(F.lit("last").alias("part"), F.right("t", F.lit(n)).alias("value")))))
    return long.groupBy("part", "value").agg(F.count("*").alias("n"))


def magnitude_bins(df: DataFrame, value: Column) -> DataFrame:
    """Bins <0, 0, 0-1, then one for each number of digits, empty ones between them too; place, bin, n, distinct_values."""
    v = df.select(value.cast("double").alias("x")).filter("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    order = F.when(F.col("x") < 0, -1).when(F.col("x") == 0, 0).when(F.col("x") < 1, 1).otherwise(digits_before(F.col("x")) + 1)
    out = v.groupBy(order.cast("int").alias("place")).agg(F.sum("n").alias("n"), F.count("*").alias("distinct_values"))  # a row a bin
    whole = F.when(F.col("place") >= 2, F.col("place"))
    every = out.agg(F.min(whole).alias("a"), F.max(whole).alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("place"))
    out = out.join(F.broadcast(every), "place", "full").select("place", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"))
    name = F.when(F.col("place") == -1, "<0").when(F.col("place") == 0, "0").when(F.col("place") == 1, "0-1").otherwise(F.concat(F.lit("1e"), (F.col("place") - 2).cast("string")))
    return out.withColumn("bin", name)


def number_values(df: DataFrame, value: Column, n: int = 10) -> DataFrame:
    """part, value, n, rank: ``top``, the n most frequent finite numbers, ties by value; ``lot``, those among them that are
    whole multiples of 1000, or of 100 where none is; ``once``, the n least numbers that occur once.  Numbers are counted
    once, written, and cut to n before anything is ranked in one place."""
    x = df.select(value.cast("double").alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    counts = settle(x.groupBy("value").agg(F.count("*").alias("n")), "numbers")
    by = lambda *order: F.row_number().over(Window.orderBy(*order))  # noqa: E731  # over n rows
    top = counts.orderBy(F.desc("n"), "value").limit(n).withColumn("rank", by(F.desc("n"), "value"))
    once = counts.filter("n = 1").orderBy("value").limit(n).withColumn("rank", by("value"))
    step = lambda k: (F.col("value") != 0) & (F.col("value") % k == 0)
    thousands = F.count_if(step(1000)).over(Window.partitionBy())
    lots = top.withColumn("many", thousands).filter(F.when(F.col("many") > 0, step(1000)).otherwise(step(100))).drop("many").withColumn("rank", by("rank"))
    tag = lambda part, d: d.select(F.lit(part).alias("part"), "value", "n", "rank")
    return tag("top", top).union(tag("lot", lots)).union(tag("once", once))


def time_repeats(df: DataFrame, value: Column, n: int = 10) -> DataFrame:
    """value, n, weekday (from Monday = 1): the moments that most rows share, ties by time."""
    v = df.select(value.cast("timestamp_ntz").alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    return v.orderBy(F.desc("n"), "value").limit(n).select(F.col("value").cast("string").alias("value"), "n", (F.weekday("value") + 1).alias("weekday"))


def time_precision(df: DataFrame, value: Column) -> DataFrame:
    """One row: filled, fraction_digits (the most that a second's fraction needs), whole_ms and whole_seconds (rows)."""
    d = df.select(value.cast("timestamp_ntz").alias("d")).filter("d is not null").groupBy("d").agg(F.count("*").alias("n"))
    micros = (F.extract(F.lit("SECOND"), "d") * 1_000_000).cast("long") % 1_000_000
    d = d.withColumn("f", micros)
    digits = F.when(F.col("f") == 0, 0).otherwise(6 - F.length(F.regexp_extract(F.lpad(F.col("f").cast("string"), 6, "0"), "0*$", 0)))
    rows = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("filled"), F.coalesce(F.max(digits), F.lit(0)).alias("fraction_digits"), rows(F.col("f") % 1000 == 0).alias("whole_ms"), rows(F.col("f") == 0).alias("whole_seconds"))


def time_written(df: DataFrame, text: Column, n: int = 5) -> DataFrame:
    """part, value, n, example: how dates and times are written.  ``shape``: the n most frequent shapes (digits 9, letters
    A), ties by shape; ``fraction``: digits after the seconds' point; ``first_over_12`` and ``second_over_12``: rows whose
    first or second number can't be a month."""
    t = settle(df.select(F.btrim(text).alias("t")).filter("t <> ''").groupBy("t").agg(F.count("*").alias("n")), "texts")
    shape = F.regexp_replace(F.regexp_replace("t", "[0-9]", "9"), "[A-Za-z]", "A")
    shapes = t.groupBy(shape.alias("value")).agg(F.sum("n").alias("n"), F.min("t").alias("example")).orderBy(F.desc("n"), "value").limit(n).select(F.lit("shape").alias("part"), "value", "n", "example")
    fraction = F.length(F.regexp_extract("t", r":[0-9]{2}[.]([0-9]+)", 1)).cast("string")
    fractions = t.groupBy(fraction.alias("value")).agg(F.sum("n").alias("n"), F.min("t").alias("example")).select(F.lit("fraction").alias("part"), "value", "n", "example")
    over = [("first_over_12", "^([0-9]{1,2})[/.-]"), ("second_over_12", "^[0-9]{1,2}[/.-]([0-9]{1,2})[/.-]")]
    hits = F.array_compact(F.array(*[F.when(F.regexp_extract("t", p, 1).try_cast("int") > 12, F.lit(k)) for k, p in over]))
    slots = t.select("t", "n", F.explode(hits).alias("part")).groupBy("part").agg(F.sum("n").alias("n"), F.min("t").alias("example")).select("part", F.lit(None).cast("string").alias("value"), "n", "example")
    return shapes.union(fractions).union(slots)


def decimal_fit(df: DataFrame, text: Column) -> DataFrame:
    """before, places and the DECIMAL that holds every number written in plain digits."""
    t = df.select(F.regexp_replace(F.btrim(text), "^[+-]?0*", "").alias("t")).filter(F.col("t").rlike(r"^\d*\.?\d*$"))
    places = F.length(F.regexp_replace(F.split_part(F.col("t"), F.lit("."), F.lit(2)), "0+$", ""))
    out = t.agg(F.coalesce(F.max(F.length(F.split_part(F.col("t"), F.lit("."), F.lit(1)))), F.lit(0)).alias("before"), F.coalesce(F.max(places), F.lit(0)).alias("places"))
    return out.withColumn("fits", F.format_string("DECIMAL(%d, %d)", F.greatest(F.lit(1), F.col("before") + F.col("places")), F.col("places")))


def time_facts(df: DataFrame, value: Column, today: str | None = None) -> DataFrame:
    """One row: filled, distinct, first, last, days, at midnight, placeholders, weekend, month starts, future, early."""
    now = F.lit(today).cast("timestamp_ntz") if today else F.current_timestamp().cast("timestamp_ntz")
    d = df.select(value.cast("timestamp_ntz").alias("d")).groupBy("d").agg(F.count("*").alias("n")).filter("d is not null")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    day = F.col("d").cast("date")
    return d.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("filled"), F.count("*").alias("distinct_values"), F.min("d").cast("string").alias("first"), F.max("d").cast("string").alias("last"), F.date_diff(F.max(day), F.min(day)).alias("days"),
        total(F.date_format("d", "HH:mm:ss") == "00:00:00").alias("midnight"), total(day.cast("string").isin(*PLACEHOLDER_DAYS)).alias("placeholders"), total(F.weekday(day) >= 5).alias("weekend"), total(F.day(day) == 1).alias("month_starts"),
        total(F.col("d") > now).alias("future"), total(F.year("d") < 1900).alias("before_1900"),
    )


def time_bins(df: DataFrame, value: Column, unit: str | None = None, limit: int | None = 2000) -> DataFrame:
    """bin, n, with empty bins between the first and the last.  Without ``unit``: year for dates without time, hour
    within one day, day up to 90 days, else month; over ``limit`` bins gaps are not filled (None: always filled).  The
    driver sees the first and the last moment."""
    d = df.select(value.cast("timestamp_ntz").alias("d")).filter("d is not null")
    lo, hi, n = d.agg(F.min("d"), F.max("d"), F.count("*")).first()
    if not n:
        return d.select(F.col("d").alias("bin"), F.lit(0).cast("long").alias("n"))
    if unit is None:
        days = (hi.date() - lo.date()).days
        unit = "year" if dict(df.select(value.alias("v")).dtypes)["v"] == "date" else "hour" if days == 0 else "day" if days <= 90 else "month"
    counts = d.groupBy(F.date_trunc(unit, "d").cast("timestamp_ntz").alias("bin")).agg(F.count("*").alias("n"))
    size = {"hour": 3600, "day": 86400, "month": 28 * 86400, "year": 365 * 86400}[unit]
    if limit is not None and (hi - lo).total_seconds() / size > limit:
        return counts
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    every = counts.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).select(F.explode(F.sequence("a", "b", step)).alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def session_fences(df: DataFrame, value: Column) -> DataFrame:
    """Seconds of the day: quartiles, Tukey fences and how many stamps lie outside."""
    s = df.select((F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)).alias("s")).filter("s is not null")
    q = s.agg(F.percentile("s", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    q = q.withColumn("low", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return s.join(F.broadcast(q), how="cross").groupBy("q1", "q3", "low", "high").agg(F.count_if(F.col("s") < F.col("low")).alias("before"), F.count_if(F.col("s") > F.col("high")).alias("after"))


def flag_counts(df: DataFrame, flag: Column) -> DataFrame:
    return df.groupBy(flag.alias("flag")).agg(F.count("*").alias("n"))


def true_rates(df: DataFrame, flag: Column, group: Column) -> DataFrame:
    """group, n, true_n, rate in percent of rows where the flag is known."""
    out = df.select(flag.alias("f"), group.alias("group_value")).groupBy("group_value").agg(F.count("f").alias("n"), F.count_if("f").alias("true_n"))
    return out.withColumn("rate", F.round(F.try_divide(100.0 * F.col("true_n"), F.col("n")), 2))


RANGES, FEW = 256, 1_000_000


def quantiles(counts: DataFrame, group: str, shares: Sequence[float]) -> DataFrame:
    """group, q: the exact quantiles of each group at ``shares``, between two values by the share of their distance.

    ``counts`` holds each value x of a group once, with its n.  Up to ``FEW`` of them one aggregate keeps the values of a
    group in order; more are dealt to ranges cut at approximate quantiles; the totals of the ranges say which hold a
    wanted rank, and only those are sorted, a task each."""
    if size_estimate(counts) <= FEW * 16:
        return counts.groupBy(group).agg(F.percentile("x", F.array(*map(F.lit, shares)), F.col("n")).alias("q"))
    cuts = counts.groupBy(group).agg(F.array_distinct(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)])).alias("cuts"), F.sum("n").alias("total"))
    cuts = cuts.withColumn("coarse", F.filter("cuts", lambda _, i: i % 16 == 15))
    below = lambda places: F.size(F.filter(places, lambda c: c < F.col("x")))
    v = counts.join(F.broadcast(cuts), group).withColumn("begin", 16 * below("coarse"))  # among 16 and 16, not among all
    v = v.withColumn("range", F.col("begin") + below(F.slice("cuts", F.col("begin") + 1, 16))).drop("cuts", "coarse", "begin")
    by, total = Window.partitionBy(group), F.col("total")
    sizes = v.groupBy(group, "range").agg(F.sum("n").alias("size"), F.first("total").alias("total"))  # RANGES rows a group at most
    sizes = sizes.withColumn("ahead", F.sum("size").over(by.orderBy("range")) - F.col("size"))
    wanted = F.array_distinct(F.array(*[f((total - 1) * s) for s in shares for f in (F.floor, F.ceil)]))
    sizes = sizes.withColumn("ranks", F.filter(wanted, lambda r: (r >= F.col("ahead")) & (r < F.col("ahead") + F.col("size")))).filter(F.size("ranks") > 0)
    held = v.drop("total").join(F.broadcast(sizes), [group, "range"])
    held = held.withColumn("end", F.sum("n").over(Window.partitionBy(group, "range").orderBy("x")) + F.col("ahead"))
    hits = held.select(group, "x", "total", F.explode(F.filter("ranks", lambda r: (r >= F.col("end") - F.col("n")) & (r < F.col("end")))).alias("rank"))
    found = hits.groupBy(group).agg(F.first("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))

    def at(share: float) -> Column:
        place = (total - 1) * share
        low, high = F.floor(place), F.ceil(place)
        return F.when(low == high, F.col("at")[low]).otherwise((high - place) * F.col("at")[low] + (place - low) * F.col("at")[high])

    return found.select(group, F.array(*map(at, shares)).alias("q"))


def number_bands(df: DataFrame, value: Column, flag: Column, bands: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """Bands of equal row counts by value: band, low, high, n, true_n, rate.

    Equal values are split between two bands where equal counts ask for it, by ``order`` and then by the flag, so that
    rows equal in all of these are interchangeable.  They are counted before anything is sorted; running sums go over
    ranges of values, cut at approximate quantiles, and over the totals of the ranges."""
    v = df.select(value.alias("x"), flag.alias("f"), *order).filter("x is not null")
    v = v.groupBy("x", *order, "f").agg(F.count("*").alias("k"))
    cuts = v.agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)]).alias("cuts")).select(F.array_distinct("cuts")).scalar()
    v = v.withColumn("cuts", cuts).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    totals = v.groupBy("range").agg(F.sum("k").alias("size"))  # RANGES rows at most
    by_range = Window.orderBy("range")
    totals = totals.select("range", (F.sum("size").over(by_range) - F.col("size")).alias("ahead"), F.sum("size").over(Window.partitionBy()).alias("rows"))
    inside = Window.partitionBy("range").orderBy("x", *order, F.asc_nulls_first("f")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = v.withColumn("end", F.sum("k").over(inside)).join(F.broadcast(totals), "range").withColumn("end", F.col("end") + F.col("ahead"))
    # band b holds the ranks over ends[b - 2] up to ends[b - 1]; the first rows % bands of them hold one more
    ends = F.array(*[(F.floor(F.col("rows") / bands) * b + F.least(F.lit(b), F.col("rows") % bands)).cast("long") for b in range(bands + 1)])
    v = v.withColumn("ends", ends).withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(bands))))
    share = F.least("end", F.element_at("ends", F.col("band") + 1)) - F.greatest(F.col("end") - F.col("k"), F.element_at("ends", F.col("band")))
    v = v.withColumn("share", share).filter("share > 0")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("share"))), F.lit(0))
    out = v.groupBy("band").agg(F.min("x").alias("low"), F.max("x").alias("high"), n(F.col("f").isNotNull()).alias("n"), n(F.col("f")).alias("true_n"))
    return out.withColumn("rate", F.round(F.try_divide(100.0 * F.col("true_n"), F.col("n")), 2))
