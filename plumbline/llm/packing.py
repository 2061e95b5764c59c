"""Operator 9: packing by minimum bin slack.

Documents are cut into full windows and one remainder.  The remainders of a task form a multiset of lengths.  Each
window takes the longest remainder and then, by subset-sum dynamic programming over a bit set, the multiset of other
lengths that comes closest to its capacity; the counts are found by tracking the bit sets back.  Where no multiset
fills a window, one more remainder is cut to close it.  What a task has left at its end, less than a window, goes into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right, insort
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import encoder

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(lengths: list[int], count: dict[int, int], room: int) -> dict[int, int]:
    """Of ascending ``lengths``, each at most ``count`` times, the multiset with the greatest sum up to ``room``."""
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        left, lot = min(count[length], room // length), 1
        while left and not reach >> room & 1:
            lot = min(lot, left)
            steps.append((length, lot, reach))
            reach |= reach << length * lot & full
            left, lot = left - lot, lot * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, lot, before in reversed(steps):
        if not before >> total & 1:
            total -= length * lot
            used[length] = used.get(length, 0) + lot
    return used


class Pool:
    """Pieces (document, start, length) that wait for a window, by length."""

    def __init__(self):
        self.by, self.count, self.lengths, self.total = {}, {}, [], 0

    def add(self, piece: tuple) -> None:
        length = piece[2]
        if length not in self.count:
            self.by[length], self.count[length] = deque(), 0
            insort(self.lengths, length)
        self.by[length].append(piece)
        self.count[length] += 1
        self.total += length

    def take(self, length: int) -> tuple:
        self.count[length] -= 1
        self.total -= length
        piece = self.by[length].popleft()
        if not self.count[length]:
            del self.by[length], self.count[length]
            self.lengths.remove(length)
        return piece

    def window(self, capacity: int) -> list[tuple]:
        out, room = [], capacity
        if self.lengths[-1] <= capacity:
            out.append(self.take(self.lengths[-1]))
            room -= out[0][2]
        for length, n in best_fill(self.lengths, self.count, room).items():
            for _ in range(n):
                out.append(self.take(length))
                room -= length
        while room and self.lengths:  # no multiset fits: cut a remainder
            doc, start, length = self.take(self.lengths[-1])
            cut = min(room, length)
            out.append((doc, start, cut))
            room -= cut
            if cut < length:
                self.add((doc, start + cut, length - cut))
        return out


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, hold: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each partition of the scan packs its own documents, so nothing is shuffled.  A task keeps at most ``hold`` waiting
    ids and those of the document at hand; beyond that windows are closed until few are left, and what does not fill a
    window waits for the next documents.  Null and empty texts have the end id alone; repeated rows are packed as often
    as they occur; null identifiers stay null; an empty input gives no row."""
    schema = pa.schema([(c, pa.int64()) for c in COLUMNS])

    def run(batches):
        from pyspark import TaskContext

        enc, end, first = encoder(vocabulary), struct.pack("<I", end_id), TaskContext.get().partitionId() << 32
        pool, made = Pool(), 0

        def emit(window):
            nonlocal made
            offset, rows = 0, []
            for (doc_id, total, cut, ids), start, length in window:
                own = ids[4 * (start - cut) : 4 * (start - cut + length)]
                rows.append((doc_id, start, length, zlib.crc32(own), total, first + made, offset))
                offset += length
            made += 1
            return rows

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

        rows: list[tuple] = []
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1))):
                ids += end
                n, start = len(ids) // 4, 0
                while n - start >= capacity:
                    rows += emit([((doc_id, n, 0, ids), start, capacity)])
                    start += capacity
                if start < n:  # only the tail's ids wait
                    pool.add(((doc_id, n, start, ids[4 * start :]), start, n - start))
                if pool.total >= hold:
                    while pool.total >= 32 * capacity:
                        rows += emit(pool.window(capacity))
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows = []
        while pool.total >= capacity:
            rows += emit(pool.window(capacity))
        while pool.total:
            rows += emit(pool.window(1 << pool.total.bit_length() - 1))
        if rows:
            yield out(rows)

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, SCHEMA)
