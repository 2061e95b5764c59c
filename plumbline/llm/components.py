"""Connected components by alternating large-star and small-star rounds, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settle


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Every node links its neighbours (the greater ones, or the lesser ones and itself) to the least of them."""
    if large:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the least node of its component.

    Loops and repeated links are ignored; no links give no row.  Rounds end when a star is all that is left, after a
    number of them that grows with the logarithm of the nodes."""
    pairs, seen = settle(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs"), None
    while True:
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen, pairs = now, settle(_star(_star(pairs, True), False), "pairs")
