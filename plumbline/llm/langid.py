"""Operator 4: language identification with a byte convolutional network, trained here in numpy.

Filters of several widths run over the bytes of fixed-length windows; the maximum of each filter over a window feeds
a softmax layer.  A document's probabilities are those of all its windows, weighted by their bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import settle

WINDOW, WIDTHS, FILTERS = 512, (2, 3, 4), 16
SAMPLE_PER_LANG, EPOCHS, BATCH, RATE = 800, 5, 64, 0.01
#: So many times the sample may be candidates for it, so that documents without letters leave enough of them.
SPARE = 4
UNKNOWN = "und"
LETTER = "\\p{L}"  # the Unicode category, in training and prediction alike


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, zero-padded; the text each belongs to; its bytes."""
    parts, owner, sizes = [], [], []
    for k, text in enumerate(texts):
        raw = text.encode()
        n = max(1, -(-len(raw) // WINDOW))
        parts.append(raw.ljust(n * WINDOW, b"\0"))
        owner += [k] * n
        sizes += [WINDOW] * (n - 1) + [max(1, len(raw) - (n - 1) * WINDOW)]
    data = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW)
    return data, np.array(owner, np.int64), np.array(sizes, np.float32)


class Net:
    """Weights: per width a table (offset, byte, filter), then a dense layer."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for t in self.tables:
            t[:, 0] = 0  # padding says nothing
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)
        self.pairs = None

    def ready(self) -> "Net":
        """Sum the tables of two neighbouring bytes, for fewer look-ups per position."""
        self.pairs = []
        for t in self.tables:
            self.pairs.append([(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)])
        return self

    def _features(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1].astype(np.uint16) * 256 + x[:, 1:]
        out = []
        for w, tables in zip(WIDTHS, self.pairs):
            n, total = WINDOW - w + 1, None
            for j, t in zip(range(0, w, 2), tables):
                got = t.take((pair if t.shape[0] > 256 else x)[:, j : j + n], axis=0)
                total = got if total is None else np.add(total, got, out=total)
            out.append(total.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1), 0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x), 64):
            z = self._features(x[i : i + 64]) @ self.dense + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + 64] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> "Net":
        rng, params = np.random.default_rng(seed), [*self.tables, self.dense, self.bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                part = order[i : i + BATCH]
                grads, step = self._gradients(x[part], y[part]), step + 1
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                for t in self.tables:
                    t[:, 0] = 0
        return self.ready()

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        feats, where = [], []
        for w, t in zip(WIDTHS, self.tables):
            n = WINDOW - w + 1
            total = t[0].take(x[:, :n], axis=0)
            for j in range(1, w):
                total += t[j].take(x[:, j : j + n], axis=0)
            at = total.argmax(axis=1)
            where.append(at)
            feats.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0])
        raw = np.concatenate(feats, axis=1)
        f = np.maximum(raw, 0)
        z = f @ self.dense + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back, out = (p @ self.dense.T) * (raw > 0), []
        rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for k, (w, t) in enumerate(zip(WIDTHS, self.tables)):
            g, own = np.zeros_like(t), back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (x[rows, where[k] + j], np.broadcast_to(filters, own.shape)), own)
            out.append(g)
        return [*out, f.T @ p, p.sum(axis=0)]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Net | None:
    """Fit on a bounded sample: for each language ``per_lang`` documents that aren't held out, one window of each.

    The sample is those of least hash of the identifier; a window starts at a hashed place.  Labelled documents are
    counted first (without reading texts), so that only the share of hashes that holds about ``SPARE`` times the sample
    is ever sorted, however many rows there are; a language where over three in four texts have no letter may get a
    smaller sample.  It comes to the driver as half a kilobyte a document: under 100 MB for 200 languages.  None if nothing
    is labelled."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    rows = rows.filter(~held_out("id") & F.col("id").isNotNull() & F.col("lang").isNotNull())
    # a row for each language, as many as the net has classes
    share = F.least(F.lit(1.0), SPARE * per_lang / F.count("*"))
    bound = rows.groupBy("lang").agg((share * 2.0**64 - 2.0**63).alias("bound"))
    bound = settle(bound, "bounds")
    bound = F.broadcast(bound) if bound.count() <= 10_000 else bound  # a join by language would move all texts
    rows = rows.join(bound, "lang").filter((F.col("h").cast("double") <= F.col("bound")) & F.col("text").rlike(LETTER))
    start = F.pmod(F.xxhash64("id", F.lit("window")), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1
    rows = rows.select("lang", "h", F.substring("text", start.cast("int"), F.lit(WINDOW)).alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))
    sample = rows.withColumn("rank", rank).filter(F.col("rank") <= per_lang).select("lang", "h", "part").toPandas().sort_values(["lang", "h", "part"])
    if not len(sample):
        return None
    langs = sorted(sample["lang"].unique())
    raw = [p.encode()[:WINDOW].ljust(WINDOW, b"\0") for p in sample["part"]]
    x = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WINDOW)
    return Net(langs).fit(x, np.searchsorted(langs, sample["lang"].to_numpy(dtype=object)))


def classifier(net: Net | None):
    """A pandas UDF: text -> struct(lang, score); null texts are unknown."""
    if net is not None:
        net.pairs = None  # small while it travels; each worker sums the pairs once
    ready: list[Net] = []

    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if net is not None and not ready:
            ready.append(net.ready())
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t]
        values = texts.tolist()
        for i in range(0, len(known) if net else 0, 64):
            part = known[i : i + 64]
            x, owner, size = windows_of([values[k] for k in part])
            p = ready[0].predict(x).astype(np.float64)
            total = np.zeros((len(part), len(net.langs)))
            np.add.at(total, owner, p * size[:, None])
            total /= total.sum(axis=1, keepdims=True)
            best = total.argmax(axis=1)
            lang[part] = np.array(net.langs, object)[best]
            score[part] = np.clip(total[np.arange(len(part)), best], 0, 1)
        return pd.DataFrame({"lang": lang, "score": score})

    return predict


def identify(docs: DataFrame, net: Net | None, text_col: str = "text", into: str = "guess") -> DataFrame:
    """Adds a struct (lang, score) predicted from the whole text.

    A null text, or one without letters, is ``und`` with score 0, as is every text if nothing was labelled.  Equal
    texts get equal results; very long texts are read window by window; an empty input gives no row."""
    return docs.withColumn(into, classifier(net)(F.when(F.col(text_col).rlike(LETTER), F.col(text_col))))
