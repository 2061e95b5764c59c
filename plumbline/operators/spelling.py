"""Spellings of one thing: fingerprints, alike 3-grams, shared prefixes, values that agree in another column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..written import settle

# Words that stand for "nothing".
PLACEHOLDERS = ("n/a", "na", "#n/a", "null", "none", "nil", "unknown", "tbd", "tba", "-", "--", "?", "??", "xx", "xxx", "test", "dummy", "missing", "not set", "not applicable", "undefined", "blank")


def fingerprint(text: Column) -> Column:
    """Lower case, the words sorted."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def fingerprint_groups(df: DataFrame, column: str) -> DataFrame:
    """fingerprint, forms, n, top: groups of at least two spellings."""
    g = counts(df, column).groupBy(fingerprint(F.col("value")).alias("fingerprint"))
    out = g.agg(F.count("*").alias("forms"), F.sum("n").alias("n"), F.max_by("value", F.struct("n", "value")).alias("top"))
    return out.filter("forms > 1")


LONGEST, ALIKE, BLOCK, BLOCKS = 60, 0.5, 256, 4


def grams(text: Column) -> Column:
    """The different 3-grams of a text in lower case, sorted; a shorter text is its own only one."""
    low = F.lower(text)
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.length(low) - 3, F.lit(0))), lambda i: F.substring(low, i + 1, F.lit(3)))))


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def alike_pairs(sets: DataFrame, least: float) -> DataFrame:
    """a, b, alike: all pairs of sets (``rank``, ``g``: a sorted array) with a Jaccard similarity of ``least`` or more, a
    before b.  Two such sets share one of each one's rarest elements, as many as its size lets it miss and one more, so
    only these are joined; sizes too far apart are dropped before sets are compared."""
    long = sets.select("rank", F.size("g").alias("size"), F.explode("g").alias("x"))
    df = long.groupBy("x").agg(F.count("*").alias("df"))
    rare = F.array_sort(F.collect_list(F.struct("df", "x")))
    prefix = long.join(df, "x").groupBy("rank", "size").agg(rare.alias("r"))
    # a share of 0.5 of 16, say: 8 have to be common, so one of the 9 rarest is
    n = (F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9) + 1).cast("int")
    prefix = prefix.select("rank", "size", F.explode(F.slice("r", F.lit(1), n)["x"]).alias("x"))
    one, two = (prefix.select(F.col("rank").alias(k), F.col("size").alias(f"{k}_size"), "x") for k in "ab")
    near = (F.col("a") < F.col("b")) & (F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size"))
    met = one.join(two, "x").filter(near).select("a", "b").distinct()
    own = lambda k: sets.select(F.col("rank").alias(k), F.col("g").alias(f"{k}_g"))
    compared = met.join(own("a"), "a").join(own("b"), "b").withColumn("alike", _jaccard(F.col("a_g"), F.col("b_g")))
    return compared.filter(F.col("alike") >= least).select("a", "b", "alike")


def first_heads(pairs: DataFrame) -> DataFrame:
    """a, b, alike: for each b that joins a group, its head a, where each in order joins the first head before it that it
    is alike to, and is a head itself if there is none.

    In rounds: those without an undecided or a head before them become heads, those alike to a head are taken."""
    pairs = settle(pairs, "alike")
    left, heads = pairs, None
    while not left.isEmpty():
        blocked = left.select(F.col("b").alias("a")).distinct()
        new = left.select("a").distinct().join(blocked, "a", "left_anti")
        heads = settle(new if heads is None else heads.union(new), "heads")
        taken = pairs.join(heads, "a", "left_semi").select("b").distinct()
        left = left.join(heads, "a", "left_anti").join(taken, "b", "left_anti").join(taken.withColumnRenamed("b", "a"), "a", "left_anti")
        left = settle(left, "left")
    if heads is None:
        return pairs
    # whoever isn't taken is a head, also one whose followers had been taken before it was known to be
    taken = settle(pairs.join(heads, "a", "left_semi").select("b").distinct(), "taken")
    led = pairs.join(taken, "b", "left_semi").join(taken.withColumnRenamed("b", "a"), "a", "left_anti")
    return led.groupBy("b").agg(F.min("a").alias("a"), F.min_by("alike", "a").alias("alike"))


def gram_groups(df: DataFrame, column: str, least: float = ALIKE, longest: int | None = LONGEST) -> DataFrame:
    """head, value, n, alike: values and the head of their group, where a group has two or more.

    Values go by frequency, then by text; each joins the first head whose 3-grams it resembles, and otherwise is a head.
    All values take part but those of over ``longest`` characters, free text that 3-grams say little about (None: those
    too).  Values of the same 3-grams count as one; the ``BLOCKS`` * ``BLOCK`` most frequent ones are taken first as heads,
    a block at a time that meets all others, so that a crowd of alike values isn't joined with itself; what is left is
    joined by its rarest 3-grams."""
    v = counts(df, column)
    v = (v if longest is None else v.filter(F.length("value") <= longest)).withColumn("g", grams(F.col("value")))
    rank = F.struct((-F.col("n")).alias("m"), "value")
    v = settle(v.withColumn("rank", rank), "values")
    sets = settle(v.groupBy("g").agg(F.min("rank").alias("rank")), "sets")
    left, found = sets, []
    for _ in range(BLOCKS):
        block = settle(left.orderBy("rank").limit(BLOCK), "block")
        own = block.select(F.col("rank").alias("a"), F.col("g").alias("a_g"))
        inner = block.select(F.col("rank").alias("b"), F.col("g").alias("b_g")).join(F.broadcast(own), F.col("a") < F.col("b"))  # BLOCK rows a side
        inner = first_heads(inner.withColumn("alike", _jaccard(F.col("a_g"), F.col("b_g"))).filter(F.col("alike") >= least).select("a", "b", "alike"))
        heads = block.join(inner.select(F.col("b").alias("rank")), "rank", "left_anti").select(F.col("rank").alias("a"), F.col("g").alias("a_g"))
        others = left.join(block.select("rank"), "rank", "left_anti")
        near = others.select(F.col("rank").alias("b"), F.col("g").alias("b_g")).join(F.broadcast(heads), F.lit(True)).withColumn("alike", _jaccard(F.col("a_g"), F.col("b_g"))).filter(F.col("alike") >= least)
        near = settle(near.groupBy("b").agg(F.min("a").alias("a"), F.min_by("alike", "a").alias("alike")), "near")
        found += [inner.select("a", "b", "alike"), near.select("a", "b", "alike")]
        left = settle(others.join(near.select(F.col("b").alias("rank")), "rank", "left_anti"), "left")
        if left.isEmpty():
            break
    else:
        found.append(first_heads(alike_pairs(left, least)).select("a", "b", "alike"))
    led = settle(reduce(DataFrame.union, found), "led")
    whole = sets.join(led.select(F.col("b").alias("rank"), "a", "alike"), "rank", "left")
    whole = whole.select("g", F.coalesce("a", "rank").alias("head"), F.coalesce("alike", F.lit(1.0)).alias("alike"))
    members = v.join(whole, "g").select(F.col("head.value").alias("head"), "value", "n", F.round("alike", 4).alias("alike"))
    several = members.groupBy("head").agg(F.count("*").alias("k")).filter("k > 1").select("head")
    return members.join(several, "head", "left_semi")


def prefix_groups(df: DataFrame, column: str, length: int = 6) -> DataFrame:
    g = counts(df, column).groupBy(F.lower(F.left("value", F.lit(length))).alias("prefix")).agg(F.count("*").alias("forms"), F.sum("n").alias("n"))
    return g.filter("forms > 1")


def same_other(df: DataFrame, column: str, other: str) -> DataFrame:
    """Values of ``other`` that several values of ``column`` share, where each of those has that one value throughout."""
    v = df.select(F.col(column).cast("string").alias("value"), F.col(other).cast("string").alias("other")).filter("value is not null")
    one = v.groupBy("value").agg(F.min("other").alias("a"), F.max("other").alias("b"), F.count("other").alias("k"), F.count("*").alias("n"))
    one = one.filter((F.col("k") == F.col("n")) & (F.col("a") == F.col("b")))
    return one.groupBy(F.col("a").alias("other")).agg(F.count("*").alias("forms"), F.sum("n").alias("n"), F.max_by("value", F.struct("n", "value")).alias("top")).filter("forms > 1")


def placeholders(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, word, n."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lower(F.trim(F.col(c).cast("string"))).alias("word")) for c in columns])))
    return long.filter(F.col("word").isin(*PLACEHOLDERS)).groupBy("column_name", "word").agg(F.count("*").alias("n"))
