"""Row matching: by key, by position, as a multiset, by whole row.

The keyed match tags both sides, brings equal keys together once and numbers their occurrences, so that duplicates pair
first with first; null keys meet null keys.  One exchange serves the numbering and the pairing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..written import settle

LEFT, RIGHT, OCC = "l", "r", "__occ__"
#: Rows of one key from which they are numbered in ranges, each a task's work; sampled places and places between cuts.
HOT, PLACES, STEP = 1_000_000, 10_000, 40
SMALL = 256 << 20  # bytes, by Spark's estimate, under which keys aren't counted before they are numbered


class DuplicateKeys(ValueError):
    pass


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def numbered(df: DataFrame, name: str = "__rn__", files: bool = False) -> DataFrame:
    """Adds the row's number, from 1: the order of ``df``'s partitions and of the rows in them.

    ``files``: ``df`` is the scan of files, and numbers follow the files' names and the places of their pieces, since
    Spark deals large pieces first.  The rows are written once with their place in the task that read them; numbers and
    the sizes that they rest on both come from that table, so no second run of the plan can disagree."""
    piece = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")] if files else [F.lit("").alias("__file"), F.lit(0).cast("long").alias("__start")]
    at = F.monotonically_increasing_id()
    rows = settle(df.select("*", *piece, F.shiftright(at, 33).alias("__part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")), "numbered")
    own = ["__file", "__start", "__part"]
    pieces = rows.groupBy(own).agg(F.count("*").alias("__size"), F.min("__at").alias("__first"))  # a row for each piece of a task
    before = F.sum("__size").over(Window.orderBy(*own).rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("__begins", F.coalesce(before, F.lit(0)))
    return rows.join(F.broadcast(pieces), own).select(*[F.col(c) for c in df.columns], (F.col("__at") - F.col("__first") + F.col("__begins") + 1).alias(name))


def size_estimate(df: DataFrame) -> int:
    """What Spark's optimizer takes for the bytes of ``df``; it multiplies the sides of joins, so it errs upwards."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def occurrences(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str = OCC, together: Sequence[str] = (), hot: int = HOT) -> DataFrame:
    """Adds the row's number among the rows equal in ``keys``, nulls included, in the order ``order``, from 1.

    A key of over ``hot`` rows is split into ranges of ``order`` at sampled places, and a range's numbers start after
    the sizes of those before it; only rows equal in all of ``order`` stay in one range.  Keys are counted first, unless
    counts of their hashes' low bits, which hardly shuffle, show that none can be hot; if none is, rows are dealt by
    ``together`` (by default ``keys``) and numbered in one step."""
    dealt = df.repartition(*together) if together else df
    in_one_step = dealt.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if hot == HOT and size_estimate(df) < SMALL:  # within one task's means whatever its keys
        return in_one_step
    large = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot)
    most = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(1 << 14))).count().agg(F.max("count")).first()[0] or 0
    n_large = large.count() if most > hot else 0
    if not n_large:
        return in_one_step

    def joined(rows: DataFrame, other: DataFrame, extra: Sequence[str], on: Sequence[str], how: str) -> DataFrame:
        other = other.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(on)], *extra)
        if "__size" not in extra and n_large <= 10_000:
            other = F.broadcast(other)
        match = reduce(Column.__and__, [same(F.col(k), F.col(f"__h{i}")) for i, k in enumerate(on)])
        return rows.join(other, match, how).drop(*[f"__h{i}" for i in range(len(on))])

    rows = df.withColumn("__place", F.struct(*order))
    places = joined(rows.select(*keys, "__place"), large, ["__n"], keys, "inner").distinct()
    # of distinct places a share that leaves about PLACES for each key, whatever its size
    some = places.filter(F.pmod(F.xxhash64("__place"), F.col("__n")) < PLACES).groupBy(*keys).agg(F.array_sort(F.collect_list("__place")).alias("__cuts"))
    cuts = some.withColumn("__cuts", F.filter("__cuts", lambda _, i: i % STEP == 0))
    rows = joined(rows, cuts, ["__cuts"], keys, "left")
    rows = rows.withColumn("__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__place"))), F.lit(0)))
    sizes = rows.filter("__cuts is not null").groupBy(*keys, "__range").agg(F.count("*").alias("__size"))
    sizes = sizes.withColumn("__size", F.sum("__size").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("__size"))
    rows = joined(rows, sizes, ["__size"], [*keys, "__range"], "left")
    own = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order))
    return rows.withColumn(into, own + F.coalesce("__size", F.lit(0))).select(*df.columns, into)


def keyed(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], duplicates: str = "index") -> DataFrame:
    """A row per pair or one-sided row: keys, __occ__, l and r (structs of the side's columns; null if absent).

    ``duplicates``: ``index`` pairs the n-th with the n-th in ``order``; ``first`` keeps a key's first row; ``unique``
    states that keys are unique, so rows aren't numbered, and fails when a key turns out not to be; ``error`` looks for
    duplicates first and refuses them."""
    if duplicates not in ("index", "first", "unique", "error"):
        raise ValueError(f"duplicates={duplicates!r}")
    if duplicates == "error":
        for side, df in (("left", left), ("right", right)):
            if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
                raise DuplicateKeys(f"the {side} side has duplicate keys")
        duplicates = "unique"
    pack = lambda df, tag: df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(tag).alias("__side"), F.struct(*df.columns).alias(tag), F.struct(*order).alias(f"__o{tag}") if duplicates in ("index", "first") else F.lit(None).alias(f"__o{tag}"))
    names = [f"__k{i}" for i in range(len(keys))]
    both = pack(left, LEFT).unionByName(pack(right, RIGHT), allowMissingColumns=True)
    if duplicates == "unique":
        both = both.withColumn(OCC, F.lit(1))
    else:
        both = occurrences(both, [*names, "__side"], ["__ol", "__or"], together=names)
        if duplicates == "first":
            both = both.filter(F.col(OCC) == 1)
    out = both.groupBy(*names, OCC).agg(F.first(LEFT, ignorenulls=True).alias(LEFT), F.first(RIGHT, ignorenulls=True).alias(RIGHT), F.greatest(F.count(LEFT), F.count(RIGHT)).alias("__n"))
    if duplicates == "unique":  # rather an error than rows merged without a word
        out = out.withColumns({s: F.when(F.col("__n") > 1, F.raise_error(F.lit("a key occurs more than once on one side"))).otherwise(F.col(s)) for s in (LEFT, RIGHT)})
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], OCC, LEFT, RIGHT)


def positional(left: DataFrame, right: DataFrame, row_number: str = "__rn__") -> DataFrame:
    """The n-th row with the n-th row, numbers given at load, before any filter."""
    return keyed(left, right, [row_number], [], "unique")


def multiset(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every distinct row with its count on either side: columns, left_count, right_count."""
    tagged = left.select(*columns, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(right.select(*columns, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    return tagged.groupBy(*columns).agg(F.sum("__l").alias("left_count"), F.sum("__r").alias("right_count"))


def count_differences(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    return multiset(left, right, columns).filter("left_count <> right_count")


def multiset_summary(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    m = multiset(left, right, columns)
    return m.agg(F.coalesce(F.sum(F.least("left_count", "right_count")), F.lit(0)).alias("matched"), F.coalesce(F.sum(F.greatest(F.col("left_count") - F.col("right_count"), F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(F.col("right_count") - F.col("left_count"), F.lit(0))), F.lit(0)).alias("only_right"))


def whole_row(left: DataFrame, right: DataFrame, columns: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of either side without an equal partner; of equal rows, the last in ``order`` are left over.

    Rows are compared by their columns themselves, so no hash can collide."""

    def left_over(own: DataFrame, other: DataFrame) -> DataFrame:
        counts = other.groupBy(*[F.col(c).alias(f"__{c}") for c in columns]).agg(F.count("*").alias("__n"))
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
        return occurrences(own, columns, order, "__rank").join(counts, on, "left").filter(F.col("__rank") > F.coalesce("__n", F.lit(0))).select(*own.columns)

    return left_over(left, right), left_over(right, left)


def value_gaps(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, gaps: distinct non-null values on one side alone.  One pass over both sides for all columns."""
    pairs = lambda df, tag: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])), F.lit(tag).alias("side"))
    values = pairs(left, 1).union(pairs(right, 2)).filter("v is not null").groupBy("column_name", "v").agg(F.min("side").alias("a"), F.max("side").alias("b"))
    found = values.groupBy("column_name").agg(F.count_if(F.col("a") == F.col("b")).alias("gaps"))
    every = left.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return every.join(F.broadcast(found), "column_name", "left").select("column_name", F.coalesce("gaps", F.lit(0)).alias("gaps"))


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left_keys, found, share: how many of the left side's distinct keys the right side has."""
    k = [F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]
    tagged = left.select(*k, F.lit(1).alias("a"), F.lit(0).alias("b")).union(right.select(*k, F.lit(0).alias("a"), F.lit(1).alias("b")))
    seen = tagged.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = seen.agg(F.count_if(F.col("a") == 1).alias("left_keys"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("found"))
    return out.withColumn("share", F.round(F.try_divide(100.0 * F.col("found"), F.col("left_keys")), 2))
