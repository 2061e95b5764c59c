"""Operator 12: spelling variants by a dictionary of trie-node pairs.

The words are the leaves of two tries, one forward and one over reversed words; every node has a number.  A word without
its i-th code point is named by two integers, the forward node of what stands before and the reversed node of what
follows; a word split at i, with nothing left out, likewise.  Joining the two finds words that differ by an insertion or
a deletion; joining left-out positions among themselves finds replacements.  Equal pairs mean equal texts, so what is
found is exact, and a pair is met by as many words as there are letters at most.

Node numbers: to a depth of ``SHALLOW``, the numeral that the letters spell; deeper nodes are counted in a task that has
all words of that beginning, in order, since the words are dealt by ranges of their first ``SHALLOW`` letters.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import scan
from .common import settle

LEAST, TWICE, TIMES, EVERY = 7, 2, 10, 31
SHALLOW = 9
_BASE = 91  # letters: a to z and U+00C0 to U+00FF
_PLAIN, _SKIP, _SKIP_FIRST = 0, 1, 2  # the last: the code point left out differs from the one before

_ASCII = scan.byte_set(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b == 0xC3)
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NODES = pa.schema([("id", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("nodes", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32()))])
_NEAR = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.int64())])


def _letters(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF, which UTF-8 writes as C3 and a byte that follows."""
    x = data[lo:hi]
    before = np.concatenate([data[lo - 1 : lo] if lo else np.zeros(1, np.uint8), x[:-1]])
    return _ASCII[x] | ((before == 0xC3) & (x >> 6 == 2))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1)
    return t


_CRC = _crc_table()


def crc32s(data: np.ndarray, first: np.ndarray, size: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """The crc32 of each run's bytes, A-Z as a-z, carried on from ``begun``."""
    out = begun ^ np.uint32(0xFFFFFFFF)
    live, j = np.arange(len(first)), 0
    while len(live := live[size[live] > j]):
        if j == 64:  # few are that long
            for i in live.tolist():
                rest = scan.LOWER[data[first[i] + j : first[i] + size[i]]].tobytes()
                out[i] = zlib.crc32(rest, int(out[i] ^ 0xFFFFFFFF)) ^ 0xFFFFFFFF
            break
        c = out[live]
        out[live] = _CRC[(c ^ scan.LOWER[data[first[live] + j]]) & np.uint32(255)] ^ (c >> np.uint32(8))
        j += 1
    return out ^ np.uint32(0xFFFFFFFF)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n) of a batch's runs, the marked ones without the code point they lose."""
    for batch in batches:
        begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
        data, begins = scan.parts(batch.column(1))
        follows = lambda p: np.concatenate([[0], np.cumsum(p >> 6 == 2)])
        kept = []
        for at, piece, first, end, row in scan.runs(data, begins, _letters):
            more = follows(piece)
            points = end - first - (more[end] - more[first])
            long = np.flatnonzero(points >= LEAST)
            a, b, points = first[long], end[long], points[long]
            kept.append((scan.names(piece, a, b), at + a, b - a, points, crc32s(piece, a, b - a, begun[row[long]])))
        if not kept:
            continue
        name, first, size, points, h = (np.concatenate(x) for x in zip(*kept))
        text = lambda i: scan.LOWER[data[first[i] : first[i] + size[i]]].tobytes().decode()
        loses = h % EVERY == 0
        whole = np.flatnonzero(~loses)
        _, some, n = np.unique(name[whole], return_index=True, return_counts=True)
        out = Counter(dict(zip(map(text, whole[some].tolist()), n.tolist())))
        for i in np.flatnonzero(loses & (points > LEAST)).tolist():
            k, w = int(h[i] % points[i]), text(i)
            out[w[:k] + w[k + 1 :]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], schema=_COUNTS)


def _digit(ch: str) -> int:
    return ord(ch) - 96 if ch < "\x80" else ord(ch) - 0xC0 + 27


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the nodes on each word's way, the root's first; words (column 1) come in order."""
    part = TaskContext.get().partitionId()
    deep, row, prev, way = 1 << 62 | part << 38, part << 38, "", [0]
    for batch in batches:
        ids, nodes, kinds, ends = [], [], [], [0]
        words = batch.column(1).to_pylist()
        for w in words:
            k, most = 0, min(len(w), len(prev))
            while k < most and w[k] == prev[k]:
                k += 1
            del way[k + 1 :]
            for ch in w[k:]:
                if len(way) <= SHALLOW:
                    way.append(way[-1] * _BASE + _digit(ch))
                else:
                    way.append(deep)
                    deep += 1
            nodes += way
            kinds += [_SKIP_FIRST, *[_SKIP if a == b else _SKIP_FIRST for a, b in zip(w, w[1:])], _PLAIN]
            ends.append(len(nodes))
            ids.append(row)
            prev, row = w, row + 1
        own = pa.array(ids) if batch.column(0).null_count else batch.column(0)
        at = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((nodes, pa.int64()), (kinds, pa.int32()))]
        yield pa.RecordBatch.from_arrays([own, batch.column(1), batch.column(2), *lists], schema=_NODES)


def _trie(words: DataFrame) -> DataFrame:
    """``words``: id, word, n.  Adds nodes and kinds; a null id becomes the word's place in the order of code points."""
    dealt = words.repartitionByRange(F.substring("word", 1, SHALLOW)).sortWithinPartitions("word")
    return dealt.mapInArrow(_numbered, "id long, word string, n long, nodes array<long>, kinds array<int>")


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows p, s, kind, n, id arrive sorted by p and s; a pair's rows may go on in the next batch."""
    kept = [np.zeros(0, np.int64)] * 5
    for batch in batches:
        rows = [np.concatenate([a, c.to_numpy()]) for a, c in zip(kept, batch.columns)]
        if not len(rows[0]):
            continue
        p, s = rows[:2]
        last = len(p) - 1 if len(p) else 0
        first = int(np.flatnonzero((p != p[last]) | (s != s[last]))[-1]) + 1 if ((p != p[last]) | (s != s[last])).any() else 0
        yield from _pairs(*[x[:first] for x in rows])
        kept = [x[first:] for x in rows]
    yield from _pairs(*kept)


def _pairs(p, s, kind, n, id_) -> Iterator[pa.RecordBatch]:
    """For each word that meets others at a pair: how many, and the most frequent of them, the first in order of ties."""
    if not len(p):
        return
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])
    group = np.cumsum(new) - 1
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(some):
        return
    group, kind, n, id_ = np.unique(group[some], return_inverse=True)[1], kind[some], n[some], id_[some]
    order = np.lexsort((id_, -n, group))
    group, kind, n, id_ = group[order], kind[order], n[order], id_[order]
    size = int(group[-1]) + 1
    out = []

    def best_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A group's number of ``rows`` (ascending), its first and its second; -1 if there is none."""
        count = np.bincount(group[rows], minlength=size)
        at = np.cumsum(count) - count
        pad = np.concatenate([rows, [-1, -1]])
        return count, np.where(count > 0, pad[np.minimum(at, len(rows))], -1), np.where(count > 1, pad[np.minimum(at + 1, len(rows))], -1)

    skips, plain, leads = np.flatnonzero(kind != _PLAIN), np.flatnonzero(kind == _PLAIN), np.flatnonzero(kind == _SKIP_FIRST)
    count, one, two = best_of(skips)
    mine = skips[count[group[skips]] > 1]  # replacements
    other = np.where(one[group[mine]] == mine, two[group[mine]], one[group[mine]])
    out.append((id_[mine], count[group[mine]] - 1, n[other], id_[other]))
    count, one, _ = best_of(leads)
    mine = plain[count[group[plain]] > 0]  # words with one more code point
    out.append((id_[mine], count[group[mine]], n[one[group[mine]]], id_[one[group[mine]]]))
    _, one, _ = best_of(plain)
    mine = leads[one[group[leads]] >= 0]  # words with one code point less
    out.append((id_[mine], np.ones(len(mine), np.int64), n[one[group[mine]]], id_[one[group[mine]]]))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=_NEAR)


def near_words(words: DataFrame) -> DataFrame:
    """``words``: id, word, n, nodes, kinds (forward).  id, near (the number of near words), best_n and best (an id)."""
    back = settle(_trie(words.select("id", F.reverse("word").alias("word"), "n")).select("id", F.col("nodes").alias("back")), "reversed")
    both = words.select("id", "n", "nodes", "kinds").join(back, "id")
    # at i the text before i goes with the rest, and with the rest but for the code point at i
    size = F.size("nodes") - 1
    node = lambda i, lost: F.struct(F.get("nodes", i).alias("p"), F.get("back", size - i - lost).alias("s"), F.when(lost == 0, _PLAIN).otherwise(F.get("kinds", i)).cast("long").alias("kind"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), size), lambda i: F.when(i < size, F.array(node(i, F.lit(0)), node(i, F.lit(1)))).otherwise(F.array(node(i, F.lit(0))))))
    rows = both.select(F.inline(pairs), "n", "id").select("p", "s", "kind", "n", "id")
    found = rows.repartition("p", "s").sortWithinPartitions("p", "s").mapInArrow(_within, "id long, near long, best_n long, best long")
    best = found.groupBy("id").agg(F.sum("near").alias("near"), F.max(F.struct("best_n", (-F.col("best")).alias("least"))).alias("b"))
    return best.select("id", "near", F.col("b.best_n").alias("best_n"), (-F.col("b.least")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms``: id, form.  id, root: the last word on the way from form to form.  Each round doubles the way covered; a
    form is ``TIMES`` as frequent as its word, so a way of 19 steps would need more occurrences than a long can count."""
    way = settle(forms.select("id", F.col("form").alias("root")), "way")
    while True:
        ahead = way.select(F.col("id").alias("at"), F.col("root").alias("further"))
        longer = settle(way.join(ahead, F.col("root") == F.col("at"), "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "way")
        if longer.filter("moved").isEmpty():
            return longer.select("id", "root")
        way = longer.select("id", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: a row per word.

    Null and empty texts have no words; an empty input gives no row; a null identifier reads as an empty one in a run's
    hash; repeated rows count each.  A text of any length is read in pieces; a word's work grows with its length.  Runs
    are counted by 64 bits within a batch and by their letters between batches."""
    counts = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(_counted, "word string, n long")
    words = settle(counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= TWICE), "words")
    trie = settle(_trie(words.select(F.lit(None).cast("long").alias("id"), "word", "n")), "forward")
    form = F.col("best_n") >= TIMES * F.col("n")
    near = trie.select("id", "word", "n").join(near_words(trie), "id", "left")
    near = settle(near.select("id", "word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")), "near")
    led = near.filter("form is not null").select("id", "form")
    last = roots(led).join(led, "id")
    named = lambda k: near.select(F.col("id").alias(k), F.col("word").alias(f"{k}_word"))
    last = last.join(named("form"), "form").join(named("root"), "root").select("id", F.col("form_word").alias("form"), F.col("root_word").alias("root"))
    return near.select("id", "word", "n", "n_near", "form_n").join(last, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
