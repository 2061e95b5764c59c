"""Operator 11: ranked lexical search with hashed max-sketches.

A term of a document has an impact, which grows with its occurrences and falls with the document's length.  A document's
impacts fold into a sketch: each coordinate holds the greatest impact of the terms hashed to it.  The weights of an item's
terms, added up by coordinate, times the sketch bound its score from above; a block's documents meet a batch of items in
one matrix product.  Documents are then scored exactly in the order of descending bounds, until the next bound is below
an item's ``TOP``-th best score so far.  What a task keeps is ``TOP`` documents an item; the best of all tasks are the
result.  Scores and bounds are integers below 2 ** 53, so the product in doubles is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import scan
from .common import settle

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
TOP = 20
WIDTH = 1024  # coordinates of a sketch
ITEMS = 1000  # a batch of items; a larger set of items is met batch by batch
CELLS = 4_000_000  # of the matrices of a block of documents
CHUNK = 64  # documents that are scored at a time

_STATS = pa.schema([("term", pa.int64()), ("n", pa.int64())])
_BEST = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 75 + 25 * n * n_docs // n_terms


class Items:
    """A batch of items: its distinct terms, and how often each item holds each."""

    def __init__(self, texts: list[str | None]):
        names, row = scan.words(pa.array(texts, pa.string()), scan.TERM)
        self.n, (self.terms, at) = len(texts), np.unique(names, return_inverse=True)
        self.counts = np.zeros((len(self.terms), self.n))
        np.add.at(self.counts, (at, row), 1)

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where names are terms of the batch, their numbers there)"""
        at = np.minimum(np.searchsorted(self.terms, names), max(len(self.terms) - 1, 0))
        hit = np.flatnonzero(self.terms[at] == names) if len(self.terms) else np.zeros(0, np.int64)
        return hit, at[hit]


def _counts(items: Items):
    """Rows (term, n): document frequencies of the batch's terms; -1: documents with terms, -2: their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(len(items.terms), np.int64), 0, 0
        for batch in batches:
            names, row = scan.words(batch.column(0), scan.TERM)
            hit, term = items.find(names)
            df += np.bincount(np.unique(row[hit] * (len(items.terms) + 1) + term) % (len(items.terms) + 1), minlength=len(items.terms))[: len(items.terms)]
            docs, total = docs + len(np.unique(row)), total + len(names)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([df[some], [docs, total]]))], schema=_STATS)

    return run


class Best:
    """The ``top`` best (score, doc_id) of each item; of equal scores the smaller doc_id, null last."""

    def __init__(self, n: int, top: int):
        self.top = top
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * n

    def least(self, item: int) -> int:
        """What a document needs to be looked at; equal scores may win by their doc_id."""
        s = self.kept[item][0]
        return int(s[-1]) if len(s) == self.top else 1

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        a, b, c = (np.concatenate(x) for x in zip(self.kept[item], (score, doc, null)))
        order = np.lexsort((b, c, -a))[: self.top]
        order = order[a[order] > 0]
        self.kept[item] = a[order], b[order], c[order]


def rank_block(names: np.ndarray, row: np.ndarray, ids: np.ndarray, null: np.ndarray, items: Items, weights: np.ndarray, norm: np.ndarray, best: Best) -> int:
    """Takes a block of documents into ``best``; returns how many scores were worked out exactly."""
    n = len(ids)
    keys = np.lexsort((names, row))
    names, row = names[keys], row[keys]
    new = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (row[1:] != row[:-1])]))
    tf = np.diff(np.concatenate([new, [len(names)]]))
    names, row = names[new], row[new]
    gain = impact(tf, norm[row])
    sketch = np.zeros(n * WIDTH, np.float64)
    np.maximum.at(sketch, row * WIDTH + (names & (WIDTH - 1)), gain)
    looked_up = np.zeros((WIDTH, items.n))
    per_item = items.counts * weights[:, None]
    np.add.at(looked_up, items.terms & (WIDTH - 1), per_item)
    bounds = sketch.reshape(n, WIDTH) @ looked_up
    exact = np.zeros((n, len(items.terms)))
    hit, term = items.find(names)
    exact[row[hit], term] = gain[hit]
    done = 0
    for item in np.flatnonzero((bounds > 0).any(0)).tolist():
        bound = bounds[:, item]
        some = np.flatnonzero(bound >= best.least(item))
        some = some[np.argsort(-bound[some], kind="stable")]
        own = np.flatnonzero(per_item[:, item])
        for at in range(0, len(some), CHUNK):
            if bound[some[at]] < best.least(item):
                break
            part = some[at : at + CHUNK]
            score = exact[np.ix_(part, own)] @ per_item[own, item]
            best.add(item, score.astype(np.int64), ids[part], null[part])
            done += len(part)
    return done


def _rank(items: Items, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items.n, top)
        step = max(1, CELLS // (WIDTH + len(items.terms) + items.n))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                names, row = scan.words(part.column(1), scan.TERM)
                if len(names):
                    ids = part.column(0)
                    null = ids.is_null().to_numpy(zero_copy_only=False)
                    norm = length_norm(scan.per_text(row, part.num_rows), n_docs, n_terms)
                    rank_block(names, row, ids.fill_null(0).to_numpy(), null, items, weights, norm, best)
        for item, (score, doc, null) in enumerate(best.kept):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item)), pa.array(doc, mask=null), pa.array(score)], schema=_BEST)

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item with a score above 0.

    Items are read in batches of ``ITEMS``, each of which meets all documents.  Null and empty texts have no term and no
    score; an item without a term that a document holds gives no row; repeated rows count and rank each by itself;
    items of one identifier, also of none, each give their rows; a null doc_id ranks last among equals.  Terms are told
    apart by 64 bits, in which two of a billion different terms agree with a probability of a few hundredths."""
    spark = docs.sparkSession
    numbered = settle(items.select(F.col(item_col).alias("item_id"), F.col("text").alias("text")).withColumn("__n", F.monotonically_increasing_id()), "items")
    out, after, texts = None, -1, docs.select(F.col(text_col).cast("string"))
    kind = numbered.schema["item_id"].dataType
    while batch := numbered.filter(F.col("__n") > after).orderBy("__n").limit(ITEMS).collect():  # ITEMS rows at most
        after = batch[-1]["__n"]
        own = Items([r["text"] for r in batch])
        stats = dict(texts.mapInArrow(_counts(own), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())  # a row a term of the batch
        n_docs, n_terms = stats.get(-1, 0), stats.get(-2, 0)
        if not n_docs:
            break
        weights = np.array([weight(n_docs, stats.get(t, 0)) for t in range(len(own.terms))], np.float64)
        found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_rank(own, weights, n_docs, n_terms, top), "item long, doc_id long, score long")
        first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(batch)], f"item long, item_id {kind.simpleString()}")
        ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long") if out is None else out


def oracle() -> str:
    """DuckDB SQL: every document that shares a term with an item is scored."""
    term = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {term} AS w FROM documents), t AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d),
s AS (SELECT count(DISTINCT row)::BIGINT AS n_docs, count(*)::BIGINT AS n_terms FROM t),
i AS (SELECT row_number() OVER () AS item, item_id, {term} AS w FROM benchmark), q AS (SELECT item, item_id, unnest(w) AS term FROM i),
f AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
v AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY term, n_docs),
x AS (SELECT q.item, q.item_id, f.row, f.doc_id, sum(v.weight * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (100 - 25 + (25 * f.n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN v USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {TOP}"""
