"""Operator 7: approximate nearest neighbours in robust-pruned directed graphs.

Each shard holds a graph of bounded out-degree.  To place a vector, a greedy beam search from the medoid proposes
neighbours; robust pruning keeps the nearest one and drops those it covers: p' goes when alpha * d(kept, p') <=
d(p, p').  With alpha over 1 some longer, diverse edges stay.  Searches walk each shard's graph with a beam; the
distances of what they find are computed again in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import settle
from .vectors import distinct_vectors, finite, members_of, nearest, numbered, own_answers, search

DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 48, 96, 1.2
SHARD_ROWS, BLOCK_ROWS, BATCH = 6000, 4096, 256
INDEX = "dim int, shard int, n int, medoid int, vectors binary, edges binary, members array<struct<vec_id:long,rid:long>>, sizes binary"
FOUND = "query_id long, rid long, vec_id long, other long, score double"


def narrowed(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in single precision, times the one power of two that brings the greatest magnitude below 1."""
    top = max(float(np.abs(a).max(initial=0)) for a in arrays)
    return [np.ldexp(a, -int(np.frexp(top)[1])).astype(np.float32) for a in arrays]


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q: the ids and squared distances of its beam, nearest first (-1: none)."""
    b, r = len(q), np.arange(len(q))[:, None]
    ids, dist, open_ = np.full((b, beam), -1), np.full((b, beam), np.inf, np.float32), np.zeros((b, beam), bool)
    seen = np.zeros((b, len(x) + 1), bool)  # the last column stands for "no edge"
    seen[:, -1] = True
    ids[:, 0], dist[:, 0], open_[:, 0] = start, ((q - x[start]) ** 2).sum(axis=1), True
    seen[:, start] = True
    live = np.arange(b)
    while len(live):
        own = r[: len(live)]
        at = open_[live].argmax(axis=1)
        open_[live, at] = False
        near = edges[ids[live, at]]
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        d = np.full(near.shape, np.inf, np.float32)
        i, j = np.nonzero(new)
        diff = x[near[i, j]] - q[live[i]]
        d[i, j] = np.einsum("ij,ij->i", diff, diff)
        all_d = np.concatenate([dist[live], d], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        best = best[own, np.argsort(all_d[own, best], axis=1, kind="stable")]
        dist[live] = all_d[own, best]
        ids[live] = np.concatenate([ids[live], np.where(new, near, -1)], axis=1)[own, best]
        open_[live] = np.concatenate([open_[live], new], axis=1)[own, best] & np.isfinite(dist[live])
        live = live[open_[live].any(axis=1)]
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point, at most ``degree`` of its candidates (-1: none), nearest first; the rest is -1."""
    rows = np.arange(len(points))
    none = (cand < 0) | (cand == points[:, None])
    y = x[np.maximum(cand, 0)]
    d = np.where(none, np.inf, ((y - x[points][:, None, :]) ** 2).sum(axis=2))
    sq = (y * y).sum(axis=2)
    apart = np.maximum(sq[:, :, None] + sq[:, None, :] - 2 * y @ y.transpose(0, 2, 1), 0)
    out, left = np.full((len(points), degree), -1), d.copy()
    for k in range(degree):
        at = left.argmin(axis=1)
        ok = np.isfinite(left[rows, at])
        if not ok.any():
            break
        out[ok, k] = cand[rows, at][ok]
        left[rows, at] = np.inf
        left[alpha * alpha * apart[rows, at] <= d] = np.inf
        same = (cand == cand[rows, at][:, None])
        left[same] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """(edges, medoid).  Missing edges are len(x)."""
    n, rng = len(x), np.random.default_rng(seed)
    [x] = narrowed(x)
    medoid = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n + 1, degree), n)
    if n > 1:
        first = rng.integers(0, n, (n, min(degree // 2, n - 1)))
        edges[:n, : first.shape[1]] = np.where(first == np.arange(n)[:, None], n, first)
    order = rng.permutation(n)
    for i in range(0, n, BATCH):
        points = order[i : i + BATCH]
        found, _ = beam_search(x, edges, medoid, x[points], beam)
        old = np.where(edges[points] == n, -1, edges[points])
        kept = robust_prune(x, points, np.concatenate([found, old], axis=1), degree, alpha)
        edges[points] = np.where(kept < 0, n, kept)
        a, k = np.nonzero(kept >= 0)
        to, back = kept[a, k], points[a]
        by = np.lexsort((back, to))
        to, back = to[by], back[by]
        ends, starts, sizes = np.unique(to, return_index=True, return_counts=True)
        width = int(sizes.max(initial=0))
        extra = np.full((len(ends), width), -1)
        extra[np.repeat(np.arange(len(ends)), sizes), np.arange(len(to)) - np.repeat(starts, sizes)] = back
        for j in range(0, len(ends), BATCH):
            e = ends[j : j + BATCH]
            cand = np.concatenate([np.where(edges[e] == n, -1, edges[e]), extra[j : j + BATCH]], axis=1)
            kept = robust_prune(x, e, cand, degree, alpha)
            edges[e] = np.where(kept < 0, n, kept)
    return edges, medoid


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("v", key=lambda s: s.map(tuple)).reset_index(drop=True)
    x = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1)
    edges, medoid = build(x)
    members, sizes = [m for ms in pdf["members"] for m in ms], np.array([len(ms) for ms in pdf["members"]], "i4")
    return pd.DataFrame([(int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), len(pdf), medoid, x.astype("<f8").tobytes(), edges.astype("<i4").tobytes(), members, sizes.tobytes())], columns=["dim", "shard", "n", "medoid", "vectors", "edges", "members", "sizes"])


def _answer(k: int, beam: int):
    def answer(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        row, out = index.iloc[0], []
        x = np.frombuffer(row["vectors"], "<f8").reshape(row["n"], -1)
        edges = np.frombuffer(row["edges"], "<i4").reshape(row["n"] + 1, -1)
        ids, rids, _ = members_of([row["members"]])
        members = ids, rids, np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], "i4"))])
        q = np.array(queries["v"].tolist(), np.float64)
        narrow, narrow_q = narrowed(x, q)
        for i in range(0, len(q), BATCH):
            found, _ = beam_search(narrow, edges, int(row["medoid"]), narrow_q[i : i + BATCH], max(beam, 2 * k))
            for own, cand in enumerate(found):
                cand = cand[cand >= 0]
                d = np.sqrt(((x[cand] - q[i + own]) ** 2).sum(axis=1))
                order = np.lexsort((ids[members[2][cand]], d))
                rid, vec_id = queries["rid"].iloc[i + own], queries["vec_id"].iloc[i + own]
                rows = sorted(own_answers(cand[order], d[order], members, rid, k), key=lambda r: (r[2], r[0], r[1]))[:k]
                out += [(vec_id, rid, int(a), int(b), float(s)) for a, b, s in rows]
        return pd.DataFrame(out, columns=["query_id", "rid", "vec_id", "other", "score"])

    return answer


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, beam: int = SEARCH_BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k nearest rows found.

    The score is the Euclidean distance in double precision, ties go to the lesser vec_id (null last).  Vectors that
    are null, zero, or hold a null, NaN or infinite component take no part; another dimension is no candidate; every
    other row is in the index, equal vectors as one node with its k + 1 least ids; an empty table gives no row."""
    v = F.col(vector_col)
    rows = numbered(vectors, F.transform(v, lambda x: x.cast("double")), finite(v) & F.exists(v, lambda x: x != 0), id_col)
    groups, shards = distinct_vectors(rows, k, SHARD_ROWS)
    index = settle(groups.groupBy("dim", "shard").applyInPandas(_index, INDEX), "graph")
    queries = rows.filter((F.col("vec_id") % every == 0) & (F.col("vec_id") != (2**63 - 1)))
    return nearest(search(index, queries, shards, BLOCK_ROWS, _answer(k, beam), FOUND), k, F.col("score"))
