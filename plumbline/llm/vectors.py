"""What the vector searches share: valid rows, equal vectors, shards and the merge of shard answers.

A search has a stated set of query rows.  Candidates lie in shards of bounded size; each shard's index is a few rows
of a written table.  Query blocks and shards meet by key, so a task holds one shard and one block of queries.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle

NO_ID = 2**63 - 1


def finite(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def numbered(vectors: DataFrame, vector: Column, keep: Column, id_col: str) -> DataFrame:
    """rid (a row's own number), vec_id (a null one sorts last), v, dim of the rows that take part; a written table."""
    rows = vectors.filter(keep).select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), vector.alias("v"))
    return settle(rows.withColumn("dim", F.size("v")), "vectors")


def distinct_vectors(rows: DataFrame, k: int, shard_rows: int) -> tuple[DataFrame, int]:
    """Each distinct vector once, with its k + 1 least (vec_id, rid): no answer can hold another of its rows.

    Spark keeps the first k + 1 of a group before the shuffle already, so a vector on a third of all rows is no hot
    group.  Adds the shard, by a hash of the vector; returns the number of shards as well."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "rid"))).filter(F.col("n") <= k + 1)
    groups = settle(first.groupBy("v", "dim").agg(F.array_sort(F.collect_list(F.struct("vec_id", "rid"))).alias("members")), "distinct")
    shards = max(1, ceil(groups.count() / shard_rows))
    return groups.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")), shards


def members_of(column: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat vec_ids and rids of lists of members, and where each list begins."""
    ids, rids, at = [], [], [0]
    for members in column:
        ids += [m["vec_id"] for m in members]
        rids += [m["rid"] for m in members]
        at.append(len(ids))
    return np.array(ids, np.int64), np.array(rids, np.int64), np.array(at, np.int64)


def search(index: DataFrame, queries: DataFrame, shards: int, block_rows: int, answer, schema: str) -> DataFrame:
    """Every query against every shard of its dimension, in blocks.

    index: dim, shard, ...; queries: rid, vec_id, v, dim.  ``answer(index rows, query rows)`` gives rows of ``schema``."""
    blocks = max(1, ceil(queries.count() / block_rows))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("block", each(blocks)).groupBy("dim", "shard", "block")
    right = queries.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards)).groupBy("dim", "shard", "block")
    empty = pd.DataFrame({c.split()[0]: [] for c in schema.split(",")})
    return left.cogroup(right).applyInPandas(lambda a, b: answer(a, b) if len(a) and len(b) else empty, schema)


def nearest(found: DataFrame, k: int, best: Column) -> DataFrame:
    """The k first rows of each query row, by ``best`` and then the least vec_id."""
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(best, "vec_id", "other"))
    out = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def own_answers(order: np.ndarray, score: np.ndarray, members: tuple, rid: int, k: int) -> list[tuple]:
    """(vec_id, rid, score) of the first k rows, own row left out, of vectors listed best first."""
    ids, rids, at = members
    out: list[tuple] = []
    for i, value in zip(order, score):
        if len(out) >= k and value != out[k - 1][2]:
            break
        out += [(ids[j], rids[j], value) for j in range(at[i], at[i + 1]) if rids[j] != rid]
    return out
