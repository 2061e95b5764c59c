"""Operator 3: exact top-k by inner product with M-trees.

Vectors get one more component, sqrt(M² - |x|²) with M the shard's greatest norm; a query gets 0.  Then the squared
distance is |q|² + M² - 2 <q, x>, so the nearest vectors are those of the greatest inner product, and a metric tree
can search for them.  A node is a page: a routing vector and a covering radius for each entry, and each entry's
distance to the vector that routes to the page.  Best-first search takes the page with the least lower bound next and
ends when that bound exceeds the k-th distance; by the triangle inequality, stored distances rule entries out before
any distance to them is computed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import settle
from .vectors import distinct_vectors, finite, members_of, nearest, numbered, own_answers, search

PAGE, FANOUT, SHARD_ROWS, BLOCK_ROWS = 1024, 16, 16_384, 1024
PAGE_SCHEMA = "dim int, shard int, page int, leaf boolean, kind string, vectors binary, parent_distance binary, radius binary, child binary, members array<struct<vec_id:long,rid:long>>, sizes binary, top double"
FOUND = "query_id long, rid long, vec_id long, other long, score long"


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(_lengths(a - b), 0))


def build(x: np.ndarray, seed: int = 5) -> tuple[list[dict], float]:
    """Pages of a bulk-loaded tree over integer vectors; page 0 is the root.  Entries: rows of x or child pages."""
    rng, wide = np.random.default_rng(seed), x.astype(np.float64)
    norms = _lengths(wide)
    top = float(norms.max())
    lifted = np.column_stack([wide, np.sqrt(np.maximum(top - norms, 0))])
    pages: list[dict] = []

    def grow(rows: np.ndarray, router: np.ndarray | None) -> int:
        page = {"router": router}
        pages.append(page)
        number = len(pages) - 1
        if len(rows) <= PAGE:
            page |= {"leaf": True, "rows": rows, "radius": np.zeros(len(rows)), "child": rows}
        else:
            picks = rng.choice(rows, min(FANOUT, len(rows) // (PAGE // 2) + 1), replace=False)
            gram = _lengths(lifted[rows])[:, None] + _lengths(lifted[picks])[None, :] - 2 * lifted[rows] @ lifted[picks].T
            near = gram.argmin(axis=1)
            parts = [(p, rows[near == i]) for i, p in enumerate(picks) if (near == i).any()]
            if len(parts) == 1:  # all at one place
                parts = [(part[0], part) for part in np.array_split(rows, -(-len(rows) // PAGE))]
            page |= {"leaf": False, "rows": np.array([p for p, _ in parts])}
            page["radius"] = np.array([_distance(lifted[part], lifted[p]).max() for p, part in parts])
            page["child"] = np.array([grow(part, p) for p, part in parts])
        page["parent"] = np.zeros(len(page["rows"])) if router is None else _distance(lifted[page["rows"]], lifted[router])
        return number

    grow(np.arange(len(x)), None)
    return pages, top


class Tree:
    """A shard's pages, ready to search."""

    def __init__(self, pdf: pd.DataFrame):
        pdf, self.pages = pdf.sort_values("page"), []
        self.top, dim = pdf["top"].iloc[0], int(pdf["dim"].iloc[0])
        for r in pdf.itertuples():
            x = np.frombuffer(r.vectors, r.kind).reshape(-1, dim)
            radius, parent, child = (np.frombuffer(v, d) for v, d in ((r.radius, "f8"), (r.parent_distance, "f8"), (r.child, "i4")))
            sizes = np.frombuffer(r.sizes, "i4")
            ids = rids = None
            if r.leaf:
                ids, rids, _ = members_of([r.members])
            self.pages.append((bool(r.leaf), x.astype(np.float64), x, radius, parent, child, _lengths(x.astype(np.float64)), ids, rids, np.concatenate([[0], np.cumsum(sizes)])))
        self.most = max((float(np.abs(p[2]).max(initial=0)) for p in self.pages), default=0.0)
        if self.most**2 * dim < 2.0**24:  # single precision holds these integers and their sums exactly
            self.pages = [(p[0], p[1].astype(np.float32), *p[2:]) for p in self.pages]
        self.computed = 0

    def _scores(self, x: np.ndarray, exact: np.ndarray, q: np.ndarray, q_exact: np.ndarray) -> np.ndarray:
        """Inner products, exact: in integers where x's precision could round."""
        bound = self.most * float(np.abs(q_exact).max(initial=0)) * max(1, len(q))
        if bound >= 2.0**52:
            return exact.astype(np.int64) @ q_exact
        if x.dtype == np.float32 and bound >= 2.0**24:
            return exact.astype(np.float64) @ q
        return (x @ q.astype(x.dtype)).astype(np.float64)

    def query(self, q_exact: np.ndarray, k: int, rid: int) -> list[tuple]:
        """(vec_id, rid, score): at least the k best rows other than ``rid``, with all ties at the last place."""
        q, best = q_exact.astype(np.float64), -np.inf
        q2 = float(q @ q)
        slack = 1e-9 * (np.sqrt(q2) + np.sqrt(self.top) + 1)
        reach = np.inf
        score, page_of, row_of, weight = (np.empty(0) for _ in range(4))
        heap = [(0.0, 0, None)]
        while heap:
            bound, number, to_router = heapq.heappop(heap)
            if bound > reach + slack:
                break
            leaf, x, exact, radius, parent, child, norms, ids, rids, at = self.pages[number]
            some = np.arange(len(x)) if to_router is None else np.flatnonzero(np.abs(to_router - parent) - radius <= reach + slack)
            if not len(some):
                continue
            self.computed += len(some)
            if 2 * len(some) > len(x):  # one product over the page costs less than gathering most of its rows
                s = self._scores(x, exact, q, q_exact)[some]
            else:
                s = self._scores(x[some], exact[some], q, q_exact)
            if leaf:
                good = s >= best
                some = some[good]
                score = np.concatenate([score, s[good]])
                page_of, row_of = np.concatenate([page_of, np.full(len(some), number)]), np.concatenate([row_of, some])
                weight = np.concatenate([weight, at[some + 1] - at[some]])
                if len(score) > k:  # k + 1 vectors hold k rows besides the query's own
                    best = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    reach = np.sqrt(max(q2 + self.top - 2 * float(best), 0))
                    keep = score >= best
                    score, page_of, row_of, weight = score[keep], page_of[keep], row_of[keep], weight[keep]
            else:
                # distance to the routing vectors, whose last component is sqrt(top - norm)
                d = np.sqrt(np.maximum(q2 + self.top - 2 * s.astype(np.float64), 0))
                low = np.maximum(d - radius[some], 0)
                for lower, c, dist in zip(low, child[some], d):
                    if lower <= reach + slack:
                        heapq.heappush(heap, (float(lower), int(c), float(dist)))
        out: list[tuple] = []
        for i in np.lexsort((row_of, page_of, -score)):
            if len(out) >= k and score[i] != out[k - 1][2]:
                break
            *_, ids, rids, at = self.pages[int(page_of[i])]
            r = int(row_of[i])
            out += [(ids[j], rids[j], score[i]) for j in range(at[r], at[r + 1]) if rids[j] != rid]
        return out


def _pages(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("v", key=lambda s: s.map(tuple)).reset_index(drop=True)
    x = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), -1)
    kind = next(t for t in ("<i2", "<i4", "<i8") if np.abs(x).max(initial=0) <= np.iinfo(t).max)
    pages, top = build(x)
    dim, shard, out = int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), []
    for n, p in enumerate(pages):
        members = [m for r in p["rows"] for m in pdf["members"][r]] if p["leaf"] else []
        sizes = np.array([len(pdf["members"][r]) for r in p["rows"]] if p["leaf"] else [], "i4")
        child = np.zeros(0, "i4") if p["leaf"] else p["child"].astype("i4")
        out.append((dim, shard, n, p["leaf"], kind, x[p["rows"]].astype(kind).tobytes(), p["parent"].astype("f8").tobytes(), p["radius"].astype("f8").tobytes(), child.tobytes(), members, sizes.tobytes(), top))
    return pd.DataFrame(out, columns=[c.split()[0] for c in PAGE_SCHEMA.split(", ")])


def _answer(k: int):
    def answer(pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        tree, out = Tree(pages), []
        for rid, vec_id, v in zip(queries["rid"], queries["vec_id"], queries["v"]):
            rows = sorted(tree.query(np.asarray(v, np.int64), k, rid), key=lambda r: (-r[2], r[0], r[1]))[:k]
            out += [(vec_id, rid, int(i), int(r), int(s)) for i, r, s in rows]
        return pd.DataFrame(out, columns=["query_id", "rid", "vec_id", "other", "score"])

    return answer


def top_inner(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k greatest inner products of
    the vectors floor(scale * x), ties to the lesser vec_id (null last).

    Vectors that are null or hold a null, NaN or infinite component take no part; vectors of another dimension are no
    candidates; a repeated row is a query and a candidate of its own; fewer candidates give fewer rows; an empty table
    gives no row.  Exact: no candidate is left out but by a bound."""
    v = F.col(vector_col)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = numbered(vectors, whole, finite(v), id_col)
    groups, shards = distinct_vectors(rows, k, SHARD_ROWS)
    index = settle(groups.groupBy("dim", "shard").applyInPandas(_pages, PAGE_SCHEMA), "mtree")
    queries = rows.filter((F.col("vec_id") % every == 0) & (F.col("vec_id") != (2**63 - 1)))
    found = search(index, queries, shards, BLOCK_ROWS, _answer(k), FOUND)
    return nearest(found, k, F.col("score").desc())


def oracle(k: int = 20, every: int = 20, scale: int = 64) -> str:
    """DuckDB SQL: all inner products of the queries."""
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
  SELECT q.vec_id AS query_id, q.rid, c.vec_id, c.rid AS other, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.rid <> q.rid AND len(c.e) = len(q.e) WHERE q.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other)::INTEGER AS rank FROM met)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
