"""Operator 13: language-model scoring with a hierarchical Pitman-Yor model.

Every word is a context with a restaurant of its own, the end of a text too, and a token is a customer of the restaurant
of the token before it; a text follows an end.  All restaurants have the root as parent, and the root a uniform base over
all known words and one for the unknown: every table is a customer of the parent, so contexts share what they know.

Seating is sampled by Gibbs: a sweep draws, from the leaves to the root, the number of tables of every (context, word)
from its distribution given all else, a^t times a generalised Stirling number, with the word's own tables taken out of
the parent first.  Up to ``STIRLING`` customers the draw is exact; above, the number of tables is that of a compound
Poisson sum given its total, drawn by its saddle point (mean and variance within 2 % of exact at 128 customers, closer
beyond).  A pair seen once has one table for good.  All contexts of a word lie in one block, so a sweep needs nothing from
other blocks but each restaurant's customers and tables, which are summed between sweeps; within a sweep they stand
still, as is usual where blocks are sampled side by side.  A word with more than a ``HOT``-th of a block's tokens is dealt
to blocks by its pairs, and its tables at the root are drawn by the driver.  After ``BURN`` sweeps each of ``SAMPLES``
sweeps is a sample, and a token's probability is the mean of its predictive probabilities over the samples.  Discounts
follow from the seats held once and twice, by level; ``STRENGTH`` is fixed.

Texts are read once more after the words are counted, in slices of about ``SLICE`` bytes: a slice's different pairs go to
their blocks with their counts, and which of them a text holds stays with the slice; at the end each slice gets back a value a
pair.  A worker holds one slice's arrays, or one block's, at a time, and gives memory back after a task or block.  The totals of the ``HEAD`` most frequent words as contexts are shared as arrays,
whatever the corpus' size; those of all others are exchanged as rows, between the blocks that hold them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import scan
from .common import give_back, lean, open_store, scratch, tidy

SINGLES, CONTEXTS, HEAD = 96, 128, 65_536  # the first two: contexts of a small model in the tests of ``Block``
BURN, SAMPLES, STRENGTH, STIRLING = 3, 3, 1.0, 128
BLOCK, HOT = 1_000_000, 8  # tokens for each block
SLICE = 8_000_000  # bytes of text
PARTS = 4  # of the blocks, whose values are worked out one part after the other, for less disk at once
SEED = 13
END = np.int64(-0x123456789ABCDEF)  # the name of the token that ends a text; others are hashes
NORMAL = 20.0  # variance from which a number of tables is drawn from the normal distribution


def held_out(id_col: str = "doc_id") -> Column:
    """A null identifier counts as an empty text, and so as training."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The names of all tokens, each text's end included, and the number of the text of each."""
    names, row = scan.words(texts)
    n = len(texts)
    out = np.full(len(names) + n, END)
    out[np.arange(len(names)) + row] = names
    return out, np.repeat(np.arange(n), scan.per_text(row, n) + 1)


class Vocabulary:
    """The head's words, sorted, with their training counts; words of the head are written by their places in it."""

    def __init__(self, head: list[tuple[int, int]], hot: int):
        rows = np.array(sorted(head), np.int64).reshape(-1, 2)
        self.names, self.counts = rows[:, 0].copy(), rows[:, 1].copy()
        self.hot = np.concatenate([self.counts > hot, [False]])

    def find(self, names: np.ndarray) -> np.ndarray:
        """Places in the head; its length where a word is none of it."""
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, len(self.names))

    def coded(self, names: np.ndarray) -> np.ndarray:
        at = self.find(names)
        return np.where(at < len(self.names), at, names)

    def named(self, code: np.ndarray) -> np.ndarray:
        known = (code >= 0) & (code < len(self.names))
        return np.where(known, self.names[np.where(known, code, 0)], code)


# ---- counts


def _counted(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    names, row = tokens(part.column(0))
    train = part.column(1).to_numpy(zero_copy_only=False)[row]
    some, at = np.unique(names, return_inverse=True)
    return some, np.bincount(at[train], minlength=len(some)), np.bincount(at, minlength=len(some))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_counted(part) for part in scan.slices(batch)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _added(*(np.concatenate(x) for x in zip(*found)))], ["name", "train", "n"])
            del found
    give_back()


def _added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys, and the sums of their values."""
    some, at = np.unique(keys, return_inverse=True)
    return some, *(np.bincount(at, x, len(some)).astype(np.int64) for x in values)


def pair_names(context: np.ndarray, names: np.ndarray) -> np.ndarray:
    return scan.mixed((context.view(np.uint64) * np.uint64(0x9FB21C651E98DF25)) ^ names.view(np.uint64))


def pack(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(x, kind=np.int64) -> np.ndarray:
    raw = x.as_py() if isinstance(x, pa.Scalar) else x
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b"", kind)


def _unpacked(column: pa.ChunkedArray, kind=np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(unpack(x, kind) for x in column)])


def _list(x: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _structs(**columns) -> pa.ListArray:
    return _list(pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns)))


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different key, in ascending order of keys, and for each key the number of its own."""
    order = np.argsort(keys)
    some = keys[order]
    new = np.concatenate([[True], some[1:] != some[:-1]])[: len(some)]
    del some
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], of


def _slice(v: Vocabulary, blocks: int, part: pa.RecordBatch) -> pa.RecordBatch:
    """What is no longer needed is let go at once: a slice's arrays are several times its texts."""
    names, row = tokens(part.column(0))
    row, train = row.astype(np.int32), part.column(1).to_numpy(zero_copy_only=False)
    texts = _structs(doc_id=part.column(2), held_out=part.column(3), n_tokens=scan.per_text(row, part.num_rows))
    before = np.concatenate([[END], names[:-1]])
    before[np.flatnonzero(row[1:] != row[:-1]) + 1] = END
    key = pair_names(before, names)
    first, of = _different(key)
    key, name, context = key[first], names[first], before[first]
    del names, before, first
    n = np.bincount(of, train[row], len(key)).astype(np.int32)
    words, w = np.unique(name, return_inverse=True)
    contexts, c = np.unique(context, return_inverse=True)
    place = (np.where(v.hot[v.find(words)][w], key, name) % blocks).astype(np.min_scalar_type(blocks))
    del key, name, context
    order = np.argsort(w * len(contexts) + c)
    order = order[np.argsort(place[order], kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    events = rank[of]
    del rank, of
    events |= row.astype(np.int64) << 32
    del row
    events.sort()
    events = pack(np.diff(events & 0xFFFFFFFF, prepend=0).astype(np.int32))
    name, context, n, place = v.coded(words)[w[order]], v.coded(contexts)[c[order]], n[order], place[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    cut = list(zip(at.tolist(), [*at[1:].tolist(), len(place)]))
    parts = _structs(block=place[at], w=[pack(name[a:b]) for a, b in cut], v=[pack(context[a:b]) for a, b in cut], n=[pack(n[a:b]) for a, b in cut])
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), texts, pa.array([events]), parts], ["slice", "texts", "events", "parts"])


def _slices(v: Vocabulary, blocks: int):
    """A row a slice: its texts, the pairs each holds by their places, and all different pairs by block, word and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in scan.slices(batch, most=SLICE)):
            yield _slice(v, blocks, part)
        give_back()

    return run


# ---- seating


@lru_cache(maxsize=8)
def log_stirling(discount: float, most: int = STIRLING) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: [customers, tables]."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], stay + s[c, 1 : c + 2])
    return s


def _saddle(c: np.ndarray, a: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.zeros(len(a)), np.full(len(a), 700.0)
    for _ in range(60):
        z = (low + high) / 2
        under = np.log(a) + np.log(-np.expm1(-z)) + z * (1 - d) < np.log(c)
        low, high = np.where(under, z, low), np.where(under, high, z)
    x, z = -np.expm1(-low), low
    mean = a * -np.expm1(-z * d) / d
    with np.errstate(over="ignore"):
        spread = a * (x * np.exp(z * (1 - d)) + x * x * (1 - d) * np.exp(z * (2 - d)))
    return mean, np.maximum(mean - c * (c / spread), 0.0)


def draw_tables(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of ``c`` customers each, where a new table has the weight ``a``."""
    t = np.minimum(c, 1)
    some = np.flatnonzero((c > 1) & (c <= STIRLING))
    some = some[np.argsort(c[some], kind="stable")]
    s = log_stirling(d)
    at = 0
    while at < len(some):
        n = int(c[some[at]])
        end = min(int(np.searchsorted(c[some], n, "right")), at + max(1, 250_000 // n))
        rows = some[at:end]
        w = s[n, 1 : n + 1] + np.log(a[rows])[:, None] * np.arange(1, n + 1)
        w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), 1)
        t[rows] = 1 + (w < (rng.random(len(rows)) * w[:, -1])[:, None]).sum(1)
        at = end
    big = np.flatnonzero(c > STIRLING)
    if len(big):
        n = c[big].astype(float)
        mean, var = _saddle(n, a[big], d)
        few = 1 + rng.poisson(np.minimum(mean, 1e6))
        many = n - rng.poisson(np.clip(n - mean, 0, 1e6))
        drawn = np.where(var >= NORMAL, np.rint(rng.normal(mean + 1 - mean / n, np.sqrt(var))), np.where(mean < n / 2, few, many))
        t[big] = np.clip(drawn, 1, n).astype(np.int64)
    return t


class Block:
    """The dishes of some words: ``code`` (word * contexts + context, ascending), customers seen, the parents' places.

    ``parent`` gives each context's, -1 for the root, which is context 0."""

    def __init__(self, code: np.ndarray, seen: np.ndarray, parent: np.ndarray):
        self.code, self.seen, self.context, self.n = code, seen, code % len(parent), len(parent)
        above = parent[self.context]
        self.up = np.where(above < 0, -1, np.searchsorted(code, code - self.context + above))
        self.level = np.where(above < 0, 0, np.where(above == 0, 1, 2))
        self.rows = [np.flatnonzero(self.level == x) for x in range(1 + self.level.max(initial=0))]

    def customers(self, tables: np.ndarray) -> np.ndarray:
        c = self.seen.copy()
        for x in range(len(self.rows) - 1, 0, -1):
            c += np.bincount(self.up[self.rows[x]], tables[self.rows[x]], len(c)).astype(np.int64)
        return c

    def first(self) -> np.ndarray:
        """One table for each dish that is eaten; a level's customers follow from those below."""
        t = np.minimum(self.seen, 1)
        for x in range(len(self.rows) - 2, -1, -1):
            t[self.rows[x]] = np.minimum(self.customers(t)[self.rows[x]], 1)
        return t

    def totals(self, tables: np.ndarray) -> np.ndarray:
        """[customers, tables] of each context's restaurant."""
        return np.stack([np.bincount(self.context, x, self.n) for x in (self.customers(tables), tables)])

    def predictive(self, tables: np.ndarray, m: "Model") -> np.ndarray:
        c = self.customers(tables)
        p = np.empty(len(c))
        for x, rows in enumerate(self.rows):
            p[rows] = m.seated(x, self.context[rows], c[rows], tables[rows], m.base if x == 0 else p[self.up[rows]])
        return p

    def sweep(self, tables: np.ndarray, m: "Model", rng: np.random.Generator) -> np.ndarray:
        p, t = self.predictive(tables, m), tables.copy()
        for x in range(len(self.rows) - 1, -1, -1):
            rows = self.rows[x]
            if x:  # the parent's prediction without this dish's tables
                c, up = self.customers(t), self.up[rows]
                left = c[up] - t[rows]
                above = m.base if x == 1 else p[self.up[up]]
                prior = m.seated(x - 1, self.context[up], left, np.minimum(t[up], left), above)
            else:
                prior = np.full(len(rows), m.base)
            others = m.totals[1, self.context[rows]] - t[rows]
            weight = (STRENGTH + m.discount[x] * np.maximum(others, 0)) * prior
            t[rows] = draw_tables(self.customers(t)[rows], weight, m.discount[x], rng)
        return t


class Model:
    """What all blocks share: discounts by level, the base probability, each restaurant's customers and tables."""

    def __init__(self, discount: list[float], n_words: int, totals: np.ndarray):
        self.discount, self.base, self.totals = discount, 1 / (n_words + 1), totals

    def new(self, level: int, context: np.ndarray) -> np.ndarray:
        """The probability that the next customer takes a new table."""
        return (STRENGTH + self.discount[level] * self.totals[1, context]) / (STRENGTH + self.totals[0, context])

    def seated(self, level: int, context: np.ndarray, c: np.ndarray, t: np.ndarray, above) -> np.ndarray:
        old = np.maximum(c - self.discount[level] * t, 0.0) / (STRENGTH + self.totals[0, context])
        return old + self.new(level, context) * above


class Shared:
    """What the driver knows: the root's customers and tables, tables of the head's contexts, both of hot words at the root."""

    def __init__(self, discount: list[float], n_words: int, sums: np.ndarray, fixed: np.ndarray, v: Vocabulary, old: "Shared | None", number: int):
        h = len(v.names)
        self.discount, self.n_words = discount, n_words
        self.tables, self.hot_customers = fixed[:h] + sums[:h], sums[h : 2 * h]
        self.hot_tables = np.minimum(self.hot_customers, 1)
        hot = np.flatnonzero(self.hot_customers)
        if old and len(hot):
            t = np.minimum(old.hot_tables, self.hot_customers)
            weight = (STRENGTH + discount[0] * (old.totals[1] - t[hot])) / (n_words + 1)
            self.hot_tables[hot] = draw_tables(self.hot_customers[hot], weight, discount[0], np.random.default_rng([SEED, number]))
        self.totals = float(sums[2 * h]), float(sums[2 * h + 1] + self.hot_tables.sum())

    def model(self, customers: np.ndarray, tables: np.ndarray) -> Model:
        """For a block, with the totals of its contexts after the root."""
        return Model(self.discount, self.n_words, np.array([[self.totals[0], *customers], [self.totals[1], *tables]], float))


_OWN = "own array<struct<place: long, n: long>>"
_BUILT = f"block long, w binary, v binary, c binary, asked array<struct<slice: long, at: binary>>, far array<struct<v: long, c: long, f: long, drawn: boolean>>, {_OWN}"
_FOUND = "slice long, block long, log_p binary, count binary"
_STATE = f"block long, words binary, contexts binary, customers binary, fixed binary, code binary, seen binary, tables binary, kept binary, far array<struct<v: long, t: array<long>>>, {_OWN}"


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a sorted array, and for each element the place of its own."""
    new = np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]
    return x[new], np.cumsum(new) - 1


def _build(v: Vocabulary):
    """All pairs of a block by word and context, with their training counts; which of them each slice asks for, what its
    contexts hold."""

    def run(key, table):
        w, context, n = v.named(_unpacked(table["w"])), v.named(_unpacked(table["v"])), _unpacked(table["n"], np.int32)
        first, of = _different(pair_names(context, w))
        c, w, context = np.bincount(of, n, len(first)).astype(np.int64), w[first], context[first]
        some, at = np.unique(context, return_inverse=True)
        order = np.argsort(np.unique(w, return_inverse=True)[1] * len(some) + at)
        c, w, context, at = c[order], w[order], context[order], at[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of = rank[of]
        ends = np.cumsum([len(unpack(x, np.int32)) for x in table["n"]])
        asked = [pack(np.diff(x, prepend=0).astype(np.int32)) for x in np.split(of, ends[:-1])]
        del rank, of
        all_of, once, drawn = (np.bincount(at, x, len(some)).astype(np.int64) for x in (c, c == 1, c > 1))
        place, h = v.find(some), len(v.names)
        far = np.flatnonzero(place == h)
        own = np.bincount(place[place < h], once[place < h], 2 * h + 6).astype(np.int64)
        own[2 * h + 4 :] = (c == 1).sum(), (c == 2).sum()
        values = [pa.array([key[0].as_py()], pa.int64()), *[pa.array([pack(x)]) for x in (v.coded(w), v.coded(context), c)], _structs(slice=table["slice"].combine_chunks(), at=asked), _structs(v=some[far], c=all_of[far], f=once[far], drawn=drawn[far] > 0), _own(own)]
        return pa.Table.from_arrays(values, names=["block", "w", "v", "c", "asked", "far", "own"])

    return run


def _own(x: np.ndarray) -> pa.ListArray:
    return _structs(place=np.flatnonzero(x), n=x[x != 0])


_STILL = ["words", "contexts", "customers", "fixed", "code", "seen"]


def _state(v: Vocabulary, key: int, words, contexts, still: list[bytes], block: Block, tables, kept: bytes) -> pa.Table:
    """A block's seats as a row, with the tables of its contexts for the sums over all blocks; no sweep changes ``still``."""
    h, c, place = len(v.names), block.customers(tables), v.find(contexts)
    per = np.bincount(block.context, tables, block.n)[1:].astype(np.int64)
    root, here = block.rows[0], v.find(words)
    hot, near, far = v.hot[here], place < h, np.flatnonzero(place == h)
    own = np.zeros(2 * h + 6, np.int64)
    own[place[near]] = per[near]
    own[h + here[hot]] = c[root[hot]]
    cool = root[~hot]
    own[2 * h :] = c[root].sum(), tables[cool].sum(), (c[cool] == 1).sum(), (c[cool] == 2).sum(), 0, 0
    samples = np.frombuffer(kept, np.int64).reshape(-1, len(tables)) if len(kept) else tables[None, :0].reshape(0, 0)
    sent = np.stack([per, *(np.bincount(block.context, x, block.n)[1:].astype(np.int64) for x in samples)], 1)[far]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * sent.shape[1]), pa.array(sent.ravel()))
    packed = [*still, pack(tables), pack(np.frombuffer(kept, np.int64))]
    values = [pa.array([key]), *[pa.array([x], pa.binary()) for x in packed], _structs(v=contexts[far], t=lists), _own(own)]
    return pa.Table.from_arrays(values, names=["block", *_STILL, "tables", "kept", "far", "own"])


def _first(v: Vocabulary):
    """The first seating of a block, given its pairs and the totals of contexts out of the head."""

    def run(key, table, back):
        w, context, c = v.named(unpack(table["w"][0])), v.named(unpack(table["v"][0])), unpack(table["c"][0])
        words, at = _runs(w[c > 0])
        some, of = np.unique(context, return_inverse=True)
        drawn = np.bincount(of, c > 1, len(some)) > 0
        contexts, n = some[drawn], 1 + int(drawn.sum())
        totals = _context_totals(v, contexts, back, c=np.bincount(of, c, len(some))[drawn], f=np.bincount(of, c == 1, len(some))[drawn])
        of = (np.cumsum(drawn) - 1)[of[c > 1]]
        once = np.bincount(at[c[c > 0] == 1], minlength=len(words))
        code = np.concatenate([np.arange(len(words)) * n, at[c[c > 0] > 1] * n + 1 + of])
        seen = np.concatenate([once, c[c > 1]]).astype(np.int64)
        order = np.argsort(code)
        block = Block(code[order], seen[order], np.concatenate([[-1], np.zeros(n - 1, np.int64)]).astype(np.int64))
        still = [pack(x) for x in (v.coded(words), v.coded(contexts), *totals, block.code, block.seen)]
        return _state(v, key[0].as_py(), words, contexts, still, block, block.first(), b"")

    return run


def _context_totals(v: Vocabulary, contexts: np.ndarray, back: pa.Table, **own: np.ndarray) -> list[np.ndarray]:
    """By context: ``own`` is all there is where no other block has it, else the row from all of them counts; customers of
    the head's contexts are its words' counts."""
    name, place = back["v"].to_numpy(), v.find(contexts)
    order = np.argsort(name)
    at = np.minimum(np.searchsorted(name[order], contexts), max(len(name) - 1, 0))
    met = np.flatnonzero(name[order][at] == contexts) if len(name) else np.zeros(0, np.int64)
    out = []
    for column, x in own.items():
        x = x.astype(np.int64)
        x[met] = back[column].to_numpy()[order][at[met]]
        if column == "c":
            x[place < len(v.names)] = v.counts[place[place < len(v.names)]]
        out.append(x)
    return out


def _sweep(v: Vocabulary, m: Shared, number: int, keep: bool):
    def run(key, table, back):
        words, contexts = (v.named(unpack(table[x][0])) for x in ("words", "contexts"))
        customers, fixed, code, seen, tables, kept = (unpack(table[x][0]) for x in ("customers", "fixed", "code", "seen", "tables", "kept"))
        parent = np.concatenate([[-1], np.zeros(len(contexts), np.int64)]).astype(np.int64)
        block, tables, place = Block(code, seen.copy(), parent), tables.copy(), v.find(contexts)
        near = place < len(v.names)
        full = fixed + _context_totals(v, contexts, back, t=np.bincount(block.context, tables, block.n)[1:])[0]
        full[near] = m.tables[place[near]]
        here = v.find(words)
        hot = block.rows[0][v.hot[here]]
        here = here[v.hot[here]]
        block.seen[hot] += m.hot_customers[here] - block.customers(tables)[hot]  # other blocks' pairs of these words
        tables[hot] = m.hot_tables[here]
        t = block.sweep(tables, m.model(customers, full), np.random.default_rng([SEED, number, key[0].as_py()]))
        t[hot], block.seen = 0, seen
        still = [table[x][0].as_py() for x in _STILL]
        return _state(v, key[0].as_py(), words, contexts, still, block, t, kept.tobytes() + (t.tobytes() if keep else b""))

    return run


def _sums(df: DataFrame, v: Vocabulary) -> np.ndarray:
    """Sums over blocks: tables by place in the head, then root customers of hot words by place, then six counts."""
    out = np.zeros(2 * len(v.names) + 6, np.int64)
    rows = df.select(F.explode("own").alias("x")).groupBy("x.place").agg(F.sum("x.n").alias("n")).toPandas()  # at most twice HEAD
    out[rows["place"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _drop(path: str) -> None:
    """A table from which nothing is worked out any more, since all that follows from it is written."""
    store, folder = open_store(path)
    store.delete_dir(folder)


def _values(v: Vocabulary, samples: list[Shared]):
    """For each slice, of the pairs of a block it asks for: the logarithm of the probability, and the word's training count."""

    def run(key, table, back):
        w, context, c = v.named(unpack(table["w"][0])), v.named(unpack(table["v"][0])), unpack(table["c"][0])
        drawn, code = unpack(table["kept"][0]).reshape(len(samples), -1), unpack(table["code"][0])
        state_words, state_contexts, seen = v.named(unpack(table["words"][0])), v.named(unpack(table["contexts"][0])), unpack(table["seen"][0])
        block = Block(code, seen, np.concatenate([[-1], np.zeros(len(state_contexts), np.int64)]).astype(np.int64))
        contexts, of = np.unique(context, return_inverse=True)
        words, at = _runs(w)
        place, here = v.find(contexts), v.find(words)
        near, hot, known = place < len(v.names), v.hot[here], np.searchsorted(words, state_words)
        own = {f"t{i}": np.bincount(of, c == 1, len(contexts)) + np.bincount(of[c > 1], t[block.context > 0], len(contexts)) for i, t in enumerate(drawn)}
        customers, *full = _context_totals(v, contexts, back, c=np.bincount(of, c, len(contexts)), **own)
        total = np.zeros(len(w))
        for t, m, tables in zip(drawn, samples, full):
            tables[near] = m.tables[place[near]]
            model = m.model(customers, tables)
            root = np.zeros((2, len(words)), np.int64)
            root[:, known] = block.customers(t)[block.rows[0]], t[block.rows[0]]
            root[:, hot] = m.hot_customers[here[hot]], m.hot_tables[here[hot]]
            p = model.seated(0, np.zeros(len(words), np.int64), *root, model.base)
            pair = np.minimum(c, 1)
            pair[c > 1] = t[block.context > 0]
            total += model.seated(1, 1 + of, c, pair, p[at])
        log_p = np.log10(total / len(samples)).astype(np.float32)
        count = np.bincount(at, c, len(words)).astype(np.int64)
        count[here < len(v.names)] = v.counts[here[here < len(v.names)]]
        asked, rows = table["asked"].combine_chunks().flatten(), []
        for x in asked.field("at"):
            i = np.cumsum(unpack(x, np.int32), dtype=np.int64)
            rows.append((pack(log_p[i]), pack(count[at[i]])))
        values = [asked.field("slice"), pa.array([key[0].as_py()] * len(rows), pa.int64()), *[pa.array([x[i] for x in rows], pa.binary()) for i in (0, 1)]]
        return pa.Table.from_arrays(values, names=["slice", "block", "log_p", "count"])

    return run


def _score(n_train: int, n_words: int):
    def run(key, table, found):
        found = found.sort_by("block")
        texts, events = table["texts"].combine_chunks().flatten(), np.cumsum(unpack(table["events"][0], np.int32), dtype=np.int64)
        doc_id, held_out, n_tokens = texts.flatten()
        log_p, count = _unpacked(found["log_p"], np.float32)[events].astype(float), _unpacked(found["count"])[events]
        row = np.repeat(np.arange(len(texts)), n_tokens.to_numpy())
        known, base, score = (np.bincount(row, x, len(texts)) for x in (count > 0, np.log10((count + 1) / (n_train + n_words + 1)), log_p))
        return pa.Table.from_arrays([doc_id, held_out, n_tokens, pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _head(counts: DataFrame) -> list[tuple[int, int]]:
    """(name, training count) of the most frequent words, ``HEAD`` at most, and of the end.

    Words are told apart by sixteenths of octaves of their counts, a few hundred classes; whole classes are taken from the
    most frequent on while they fit, so that the driver sees these words alone, and not the best of every task."""
    octave = F.floor(F.log2("n") * 16).alias("octave")
    left, least = HEAD - 1, None
    for r in counts.groupBy(octave).count().orderBy(F.desc("octave")).collect():  # some hundred rows
        if r["count"] > left:
            break
        left, least = left - r["count"], r["octave"]
    wanted = F.col("name") == int(END)
    if least is not None:
        wanted |= F.col("octave") >= least
    return [(r["name"], r["train"]) for r in counts.select("name", "train", octave).filter(wanted).collect()]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per row of ``docs``.

    Null and empty texts are an end alone; repeated rows (one identifier and text) each train and are scored alike; a
    null identifier trains; an empty input gives no row.  Texts of any length are read in pieces, a batch of texts at a
    time.  Words are told apart by 64 bits.  Without training text every token is unknown.  Reruns agree: draws follow
    from a seed, the sweep and the block."""
    with tidy(docs.sparkSession, SLICE):
        return _fit(docs, id_col, text_col)


def _fit(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()

    def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
        path = scratch(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    text, train = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (~held_out(id_col)).alias("train")
    counts = docs.select(text, train).mapInArrow(_count, "name long, train long, n long").groupBy("name").agg(F.sum("train").alias("train"), F.sum("n").alias("n"))
    counts, counts_path = written(counts, "counts")
    n_all, n_train, n_words = counts.agg(F.sum("n"), F.sum("train"), F.count_if(F.col("train") > 0)).first()
    if not n_all:
        return spark.createDataFrame([], f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    v, blocks = Vocabulary(_head(counts), BLOCK // HOT), max(16, n_all // BLOCK)
    _drop(counts_path)

    texts = docs.select(text, train, F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"))
    cut = f"slice long, texts array<struct<doc_id: {kind}, held_out: boolean, n_tokens: long>>, events binary, parts array<struct<block: long, w: binary, v: binary, n: binary>>"
    slices, slices_path = written(texts.mapInArrow(_slices(v, blocks), cut), "slices")
    pairs = slices.select("slice", F.explode("parts").alias("p")).select("slice", "p.*")
    built, built_path = written(pairs.groupBy("block").applyInArrow(lean(_build(v)), _BUILT), "built")
    events, _ = written(slices.drop("parts"), "events")
    _drop(slices_path)
    fixed = _sums(built, v)
    # contexts out of the head and in several blocks: customers, pairs seen once, blocks that hold them or draw their tables
    far = built.select("block", F.explode("far").alias("x")).select("block", "x.*").groupBy("v")
    far = far.agg(F.sum("c").alias("c"), F.sum("f").alias("f"), F.collect_list(F.struct("block", "drawn")).alias("at"))
    far, far_path = written(far.filter(F.size("at") > 1), "contexts")
    own = built.select("block", "w", "v", "c")
    back = far.select("v", "c", "f", F.explode("at").alias("at")).filter("at.drawn").select("v", "c", "f", "at.block")
    step = own.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(lean(_first(v)), _STATE)
    state, path = written(step, "seats")
    sums, h = _sums(state, v), len(v.names)
    seats = [(sums[-4] + (sums[h : 2 * h] == 1).sum(), sums[-3] + (sums[h : 2 * h] == 2).sum()), (fixed[-2], fixed[-1])]
    discount = [float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a else 0.5 for a, b in seats]
    shared, samples = Shared(discount, n_words, sums, fixed, v, None, 0), []
    for number in range(BURN + SAMPLES):
        sent = state.select("block", F.explode("far").alias("x")).select("block", "x.v", F.col("x.t")[0].alias("t"))
        back = sent.groupBy("v").agg(F.sum("t").alias("t"), F.collect_list("block").alias("blocks")).filter(F.size("blocks") > 1).select("v", "t", F.explode("blocks").alias("block"))
        step = state.drop("far", "own").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(lean(_sweep(v, shared, number, number >= BURN)), _STATE)
        old, (state, path) = path, written(step, "seats")
        _drop(old)
        shared = Shared(discount, n_words, _sums(state, v), fixed, v, shared, number + 1)
        if number >= BURN:
            samples.append(shared)
    sent = state.select(F.explode("far").alias("x")).groupBy("x.v").agg(*[F.sum(F.col("x.t")[i + 1]).alias(f"s{i}") for i in range(SAMPLES)])
    tables = [(F.col("f") + F.coalesce(f"s{i}", F.lit(0))).alias(f"t{i}") for i in range(SAMPLES)]
    back = far.join(sent, "v", "left").select(F.explode("at.block").alias("block"), "v", "c", *tables)
    seated = built.select("block", "w", "v", "c", "asked").join(state.select("block", "words", "contexts", "code", "seen", "kept"), "block")
    found_paths = []
    for i in range(PARTS):
        seats, totals = (x.filter(F.col("block") % PARTS == i).groupBy("block") for x in (seated, back))
        found = seats.cogroup(totals).applyInArrow(lean(_values(v, samples)), _FOUND)
        found_paths.append(written(found, "found")[1])
    found = spark.read.schema(_FOUND).parquet(*found_paths)
    for x in (built_path, far_path, path):
        _drop(x)
    scored = events.groupBy("slice").cogroup(found.groupBy("slice"))
    scored = scored.applyInArrow(lean(_score(n_train, n_words)), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
