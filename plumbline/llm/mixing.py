"""Operator 2: mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each document, in the shuffled order of its source, gets a virtual finish time: the words its source has sent up to
and including it, divided by the source's target.  Sources are sent again, up to ``epochs`` times in all.  The copies
are sorted by virtual finish time over all sources, and the mix ends where its words reach the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
BINS = 1000
LOT = 65_536
SEED = "mix-1:"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``totals``: key, source, source_size, a row per source.  Adds rank and target.

    Targets fill up like water: every source gets the same level times its weight, but ``epochs`` times its size at
    most; the level is the one whose targets sum to all sizes.  With sources in ascending order of cap / weight, the
    capped ones are a prefix, so running sums find the level.  Works on one row per source."""
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    t = totals.withColumn("rank", F.row_number().over(by_code))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long"))
    t = t.withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    up, down = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(up), F.lit(0))
    t = t.withColumn("level", left / F.sum("weight").over(down))
    # the first source that its cap doesn't stop sets the level of all from there on
    open_at = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every)
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("cap") / F.col("weight"))).over(every)
    t = t.withColumn("open", open_at).withColumn("first", first)
    first_level = F.min(F.when(F.col("cap") / F.col("weight") == F.col("first"), F.col("level"))).over(every)
    t = t.withColumn("at", first_level)
    target = F.when(F.col("at") * F.col("weight") < F.col("cap"), F.col("at") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return t.select("key", "rank", "source_size", target.alias("target"))


def _finish(epoch: Column) -> Column:
    """Null where the source's target is 0."""
    return F.try_divide(epoch * F.col("source_size") + F.col("sent"), F.col("target"))


def _cut(queue: DataFrame, budget: int, epochs: int) -> tuple:
    """The last (virtual finish, rank, order, size) that the budget takes.

    The copies are split by virtual time into ``BINS`` ranges; the range in which the running sum crosses the budget
    is split again until it holds few copies, and only that one is sorted."""
    copies = queue.filter("size > 0").select("rank", "h", "size", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("e"), "source_size", "sent", "target")
    copies = copies.select("rank", "h", "size", _finish(F.col("e")).alias("v"))
    low, high, before = 0.0, float(epochs) * len(WEIGHTS) * sum(WEIGHTS), 0
    top = copies.agg(F.max("v")).first()[0]
    if top is None:
        return None
    high = top
    while True:
        part = copies.filter((F.col("v") >= low) & (F.col("v") <= high))
        width = (high - low) / BINS
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        found = part.groupBy(at.cast("int").alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect()  # BINS rows at most
        crossing = None
        for r in found:
            if before + r["size"] > budget:
                crossing = r
                break
            before += r["size"]
        if crossing is None:
            return (high, None, None, None)
        low, high = crossing["low"], crossing["high"]
        if crossing["n"] <= 100_000 or low == high:  # least and greatest lie in different bins, so a range always shrinks
            break
    last = copies.filter((F.col("v") >= low) & (F.col("v") <= high))
    order = ["v", "rank", "h", "size"]
    run = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = last.withColumn("run", run).filter(F.col("run") <= budget - before).orderBy(*(F.col(c).desc() for c in order)).first()
    return (low, 0, "", 0) if got is None else tuple(got[c] for c in order)


def mix(docs: DataFrame, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, copies and the columns ``keep``.

    The order within a source is that of md5(seed, doc_id, text): reruns agree, rows of one identifier spread like any
    others, and rows equal in both are interchangeable.  Null and empty texts have size 0 and take nothing; a null source is a source of its own, the
    last; an empty input gives no row.  A source's rows are summed in buckets of the shuffled order, so a source with
    a third of all rows is no single task.  Rows equal in doc_id, text and ``keep`` are summed as one row with a count
    for each lot of ``LOT`` rows of the input, and dealt out again once their place is known: neither are they."""
    order = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("size"), F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), source_col)).alias("key"), order.alias("h"), F.floor(F.monotonically_increasing_id() / LOT).alias("lot"), *keep)
    sized = settle(rows, "sized")
    n = sized.count()
    digits = next(d for d in range(1, 9) if d == 8 or 16**d * 500 >= n)
    bucket = F.substring("h", 1, digits)
    sums = settle(sized.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size")), "sums")
    totals = sums.groupBy("key").agg(F.sum("bucket_size").alias("source_size")).withColumn("source", F.when(F.col("key") != "n", F.expr("substring(key, 2)")))
    targets = settle(source_targets(totals, epochs), "targets")
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).join(targets, "key").drop("bucket_size")
    equal = sized.groupBy("key", "h", "size", "doc_id", *keep, "lot").agg(F.count("*").alias("n"))
    within = Window.partitionBy("key", "bucket").orderBy("h", "size", *keep, "lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = equal.withColumn("bucket", bucket).withColumn("own", F.sum(F.col("size") * F.col("n")).over(within)).join(offsets, ["key", "bucket"])
    queue = queue.withColumn("later", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))  # LOT rows at most
    queue = settle(queue.withColumn("sent", F.col("ahead") + F.col("own") - F.col("later") * F.col("size")).drop("key", "bucket", "own", "ahead", "lot", "n", "later"), "queue")
    budget = totals.agg(F.sum("source_size")).first()[0] or 0
    cut = _cut(queue, budget, epochs)
    copies = F.lit(0)
    if cut is not None:
        v, rank, h, size = cut
        for e in range(epochs):
            finish = _finish(F.lit(e))
            taken = finish <= F.lit(v)
            if rank is not None:
                same = F.struct("rank", "h", "size") <= F.struct(F.lit(rank), F.lit(h), F.lit(size).cast("long"))
                taken = (finish < F.lit(v)) | ((finish == F.lit(v)) & same)
            copies = copies + F.when((F.col("target") > 0) & taken, 1).otherwise(0)
    out = queue.withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *keep)


def oracle() -> str:
    """DuckDB SQL for :func:`mix` without ``copies``."""
    return f"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, source,
         md5('{SEED}' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS h FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighted AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * {EPOCHS} AS cap FROM totals),
levels AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM weighted),
water AS (SELECT min_by(level, ratio) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT l.source, l.rank, l.source_size, CASE WHEN water.level * l.weight < l.cap THEN water.level * l.weight ELSE l.cap::DOUBLE END AS target FROM levels l, water),
queue AS (
  SELECT s.doc_id, s.size, s.h, t.rank, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.h, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS sent,
         row_number() OVER () AS rid
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT q.*, e, (e * source_size + sent)::DOUBLE / target AS v FROM queue q, range({EPOCHS}) r(e) WHERE target > 0 AND size > 0),
run AS (SELECT rid, size, sum(size) OVER (ORDER BY v, rank, h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM copies),
taken AS (SELECT rid, sum(size) AS taken FROM run WHERE run <= (SELECT sum(size) FROM sized) GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queue LEFT JOIN taken USING (rid)"""
