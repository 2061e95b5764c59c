"""Words of whole texts found with numpy, an Arrow batch at a time, each named by 64 bits.

A text's bytes are cut at separators; a word's name is a polynomial of its bytes, taken from running sums, then mixed.
Texts are worked on in pieces that end between words, so that memory doesn't grow with a text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 17  # bytes: what is worked out for them stays in a processor's cache
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # only A-Z


def byte_set(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes of words as the runs of all but blanks; of terms as the runs of letters, digits and all code points from 128.
WORD = byte_set(lambda b: b != 32 and not 9 <= b <= 13)
TERM = byte_set(lambda b: b >= 128 or chr(b).isalnum())


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)[LOWER] | np.uint64(1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_BASE, _BASE_INVERSE))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null reads as empty."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    begins = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, begins


def of_kind(kind: np.ndarray):
    return lambda data, lo, hi: kind[data[lo:hi]]


def runs(data: np.ndarray, begins: np.ndarray, inside):
    """(at, bytes, first, end, text) of the runs of bytes that ``inside(data, lo, hi)`` marks, piece by piece: ``at`` is
    where the piece begins in ``data``, the places of runs are in the piece."""
    at, last = int(begins[0]), int(begins[-1])
    while at < last:
        stop = min(at + PIECE, last)
        while stop < last:  # on to the end of a run
            ahead = inside(data, stop - 1, min(stop + 4096, last))
            gap = np.flatnonzero(~ahead)
            if len(gap):
                stop += max(int(gap[0]) - 1, 0)
                break
            stop = min(stop + 4096, last)
        piece = data[at:stop]
        within = inside(data, at, stop)
        before = np.concatenate([[False], within[:-1]])
        lo, hi = np.searchsorted(begins, [at, stop])
        new = begins[lo:hi] - at
        before[new[new < len(piece)]] = False
        first = np.flatnonzero(within & ~before)
        after = np.concatenate([within[1:] & before[1:], [False]])  # the next byte goes on with the run
        end = np.flatnonzero(within & ~after) + 1
        # a text's first run, then the text's number as often as it has runs
        of = np.searchsorted(first, new)
        yield at, piece, first, end, np.repeat(np.arange(lo - 1, hi), np.diff(np.concatenate([[0], of, [len(first)]])))
        at = stop


def names(piece: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each run, without regard to the case of A-Z."""
    forth, back = _powers(1 << len(piece).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_values()[piece] * forth[: len(piece)])])
    return mixed((sums[end] - sums[first]) * back[first])


def words(texts: pa.Array, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """The names of all words in order, and the number of the text of each."""
    found = [(names(p, a, b), t) for _, p, a, b, t in runs(*parts(texts), of_kind(kind))]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def slices(batch: pa.RecordBatch, column: int = 0, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of up to ``most`` bytes of text, one text at least, so that what is worked out for its words is
    small next to the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def per_text(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n)
