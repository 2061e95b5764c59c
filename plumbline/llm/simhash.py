"""Operator 8: SimHash near-duplicates by pigeonring filtering.

The 64 bits form a ring of ``SEGMENTS`` segments.  If two fingerprints differ in at most ``BITS`` bits, then at some
segment a chain begins whose first l segments differ in at most l * BITS / SEGMENTS bits, for every l.  With eight
segments and three bits the first two segments of the chain are equal and the next three differ in one bit at most,
so two of those three are equal: 8 starts times 3 choices give keys of 32 equal bits.  Rows that meet in a key are
held against the whole chain and then against all bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import settle
from .components import components

BITS, SEGMENTS, SHINGLE, SEED = 3, 8, 3, 42
BLOCK = 4096


def fingerprint(text: str | None) -> int:
    """ASCII lower case, words between ASCII white space, 3-word shingles with repeats, XXH64; strict majority."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if n * 2 > len(hashes) else "0" for n in ones), 2)


def fingerprints(text):
    """The column of fingerprints, as signed longs."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(of, "long")(text)


def ring_keys(fp):
    """Native: for each start and left-out segment, (place, the 32 bits of the four equal segments) in one long."""
    size = 64 // SEGMENTS
    seg = lambda i: F.shiftrightunsigned(fp, size * (i % SEGMENTS)).bitwiseAND(F.lit((1 << size) - 1))
    keys = []
    for i in range(SEGMENTS):
        for out in range(3):
            key = F.lit(i * 3 + out).cast("long")
            for j in [0, 1, *(2 + j for j in range(3) if j != out)]:
                key = F.shiftleft(key, size).bitwiseOR(seg(i + j))
            keys.append(key)
    return F.array(*keys)


def chain_holds(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The pigeonring test from segment ``place`` // 3 on, and at its end the full Hamming distance."""
    size, diff, total = 64 // SEGMENTS, a ^ b, np.zeros(len(a), np.int64)
    ok = np.ones(len(a), bool)
    for length in range(1, SEGMENTS + 1):
        at = ((place // 3 + length - 1) % SEGMENTS * size).astype(np.uint64)
        total += np.bitwise_count(diff >> at & np.uint64((1 << size) - 1))
        ok &= total <= length * BITS // SEGMENTS
    return ok


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels of the links' components among n items: the least item of each."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key, at most one per row: a forest, never all pairs of a group."""
    label, lag, n = np.arange(len(keys)), 0, len(keys)
    place, active = keys >> np.int64(32), np.arange(n)
    while True:
        lag += 1
        active = active[active + lag < n]
        active = active[keys[active] == keys[active + lag]]
        if not len(active):
            break
        todo = active[label[active] != label[active + lag]]
        good = todo[chain_holds(fps[todo], fps[todo + lag], place[todo])]
        if len(good):
            label = _forest(n, np.concatenate([np.arange(n), good]), np.concatenate([label, good + lag]))
    own = np.flatnonzero(label != np.arange(n))
    return fps[own], fps[label[own]]


def _within(batches):
    """Rows arrive sorted by key; a run may go on in the next batch."""
    kept_k, kept_f = np.empty(0, np.int64), np.empty(0, np.int64)

    def out(k, f):
        a, b = _links(k, f.view(np.uint64))
        return pd.DataFrame({"u": a.view(np.int64), "v": b.view(np.int64)})

    for pdf in batches:
        k, f = np.concatenate([kept_k, pdf["key"].to_numpy()]), np.concatenate([kept_f, pdf["fp"].to_numpy()])
        done = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
        kept_k, kept_f = k[done:], f[done:]
        if done:
            yield out(k[:done], f[:done])
    if len(kept_k):
        yield out(kept_k, kept_f)


def _between(batches):
    """Blocks of large groups: rows sorted by (key, first block, second block); groups hold two blocks at most."""
    kept = None

    def out(pdf):
        frames = []
        for _, group in pdf.groupby(["key", "one", "two"], sort=False):
            a, b = _links(group["key"].to_numpy(), group["fp"].to_numpy().view(np.uint64))
            frames.append(pd.DataFrame({"u": a.view(np.int64), "v": b.view(np.int64)}))
        return pd.concat(frames)

    for pdf in batches:
        pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
        last = pdf.iloc[-1] if len(pdf) else None
        if last is None:
            continue
        same = (pdf["key"] == last["key"]) & (pdf["one"] == last["one"]) & (pdf["two"] == last["two"])
        kept = pdf[same]
        if (~same).any():
            yield out(pdf[~same])
    if kept is not None and len(kept):
        yield out(kept)


def similar_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of ``fp`` at most BITS apart.

    Keys shared by over ``block`` fingerprints are dealt out as pairs of hashed blocks, so that a task holds two
    blocks at most; the table of such keys has at most a row for every ``block`` rows of keys."""
    keys = settle(distinct.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key")), "keys")
    counts = keys.groupBy("key").count()
    big = settle(counts.filter(F.col("count") > block), "big")
    some, n_big = keys, big.count()
    if n_big:
        some = keys.join(F.broadcast(big) if n_big <= 10_000 else big, "key", "left_anti")
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = some.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInPandas(_within, "u long, v long")
    if n_big:
        wide = keys.join(F.broadcast(big) if n_big <= 10_000 else big, "key").withColumn("blocks", F.ceil(F.col("count") / (block // 2)).cast("int"))
        wide = wide.withColumn("own", F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int"))
        wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        wide = wide.select("key", "fp", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
        dealt = wide.repartition(parts, "key", "one", "two").sortWithinPartitions("key", "one", "two", "fp")
        links = links.union(dealt.mapInPandas(_between, "u long, v long"))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, text_hash, fp, root, component_id.

    ``component_id`` is the least identifier in the component, null if it has none but nulls; ``root`` names the
    component.  Null and empty texts have fingerprint 0 and are linked like any other; equal fingerprints meet before
    any comparison, so large groups of copies cost one row; repeated rows stay; an empty input gives no row."""
    rows = settle(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), fingerprints(F.col(text_col)).alias("fp")), "fingerprints")
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(settle(similar_links(distinct.select("fp")), "links"))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(named.join(least, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp")


def hexed(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
