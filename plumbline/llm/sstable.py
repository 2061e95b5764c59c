"""Operator 1: tokenised documents in sorted-string-table shards.

A shard holds ascending keys in blocks.  Within a block a key stores only what differs from the key before, with a
full key at every 16th entry (a restart).  Behind the blocks come a sparse index (last key, offset and length of each
block), a Bloom filter over the keys and a fixed footer.  A lookup asks the Bloom filter, binary-searches the index,
then the restarts of one block.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import open_store, rows_frame, scratch, settle
from .tokens import encoder

FOOTER = struct.Struct("<QQQQQQI8s")
MAGIC = b"PLBSST01"
RESTART, BLOCK_BYTES, BITS_PER_KEY, PROBES = 16, 64 * 1024, 10, 7


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do; null is the empty key and so comes first."""
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Streams entries in ascending key order to ``out``; only the sparse index and the keys' bits stay in memory."""

    def __init__(self, out):
        self.out, self.at, self.index, self.keys = out, 0, [], []
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""
        self.n_docs = self.n_tokens = 0

    def add(self, key: bytes, value: bytes, tokens: int) -> None:
        if self.in_block % RESTART == 0:
            shared = 0
            self.restarts.append(len(self.block))
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), min(len(key), len(self.last)))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block, self.last = self.in_block + 1, key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + tokens
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.in_block:
            body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            at, size = self._put(body + struct.pack("<I", zlib.crc32(body)))
            self.index.append((self.last, at, size))
            self.block, self.restarts, self.in_block = bytearray(), [], 0

    def close(self) -> None:
        self._flush()
        index_at = self._put(b"".join(_varint(len(k)) + k + _varint(at) + _varint(size) for k, at, size in self.index))
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self._put(bytes(bloom))
        self._put(FOOTER.pack(*index_at, *bloom_at, self.n_docs, self.n_tokens, bits, MAGIC))


class Table:
    """One shard, read by ranges: ``get`` for a key, iteration for all entries in order."""

    def __init__(self, file):
        self.file, size = file, file.size()
        *_, magic = foot = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        index_at, index_size, bloom_at, bloom_size, self.n_docs, self.n_tokens, self.bits, _ = foot
        self.bloom, raw, at = self._at(bloom_at, bloom_size), self._at(index_at, index_size), 0
        self.last_keys, self.blocks = [], []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.last_keys.append(key)
            self.blocks.append((offset, length))

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        data = self._at(*self.blocks[k])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        n = struct.unpack("<I", data[-8:-4])[0]
        return data[: -8 - 4 * n], list(struct.unpack(f"<{n}I", data[-8 - 4 * n : -8]))

    @staticmethod
    def _entries(body: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            own, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + own]
            yield key, body[at + own : at + own + size]
            at += own + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self._entries(self._block(k)[0])

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key, [] if absent."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        out = []
        for k in range(bisect_left(self.last_keys, key), len(self.blocks)):
            body, restarts = self._block(k)
            firsts = [next(self._entries(body, r))[0] for r in restarts]
            start = restarts[max(0, bisect_left(firsts, key) - 1)]
            for found, value in self._entries(body, start):
                if found > key:
                    return out
                if found == key:
                    out.append(value)
        return out


def _pack(ids: bytes, wide: bool) -> bytes:
    if wide:
        return ids
    values = np.frombuffer(ids, "<u4")
    if values.max(initial=0) >> 16:
        raise ValueError("ids over 65,535 need wide=True")
    return values.astype("<u2").tobytes()


def write_tables(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write one shard per range partition; returns the manifest.

    Rows are range-partitioned by identifier; the text's hash and a row number follow in the range key, so that one
    identifier on very many rows still spreads over shards.  Every attempt of a task writes a file of its own and the
    manifest, a written table, names the files that count.  A null text has the end id alone; a null identifier sorts
    first; repeated identifiers keep every row; an empty input gives an empty manifest.  ``wide``: store ids in four
    bytes instead of two, needed for vocabularies over 65,536."""

    def write(batches):
        from pyspark import TaskContext

        shard, enc, end = TaskContext.get().partitionId(), encoder(vocabulary), struct.pack("<I", end_id)
        writer = path = None
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1))):
                if writer is None:
                    store, base = open_store(folder)
                    store.create_dir(base)
                    path = f"{shard:06d}-{uuid.uuid4().hex}.sst"
                    stream = store.open_output_stream(f"{base}/{path}")
                    writer = Writer(stream)
                ids += end
                writer.add(key_of(doc_id), _pack(ids, wide), len(ids) // 4)
        if writer:
            writer.close()
            stream.close()
            made = [pa.array([shard], pa.int32()), pa.array([path]), pa.array([writer.n_docs]), pa.array([writer.n_tokens])]
            yield pa.RecordBatch.from_arrays(made, names=["shard", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("r", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(F.col("k").asc_nulls_first(), "h", "r").sortWithinPartitions(F.col("k").asc_nulls_first(), "h", "r")
    return settle(ranged.select("k", "t").mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "manifest")


def read_tables(manifest: DataFrame, folder: str, wide: bool = False) -> DataFrame:
    """Per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = manifest.withColumn("base", F.coalesce(before, F.lit(0))).repartitionByRange(parts, "shard")  # dealt evenly

    def read(batches):
        columns = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]
        for pdf in batches:
            for shard, path, base in zip(pdf["shard"], pdf["path"], pdf["base"]):
                store, root = open_store(folder)
                with store.open_input_file(f"{root}/{path}") as file:
                    at, out = int(base), []
                    for key, value in Table(file):
                        ids = value if wide else np.frombuffer(value, "<u2").astype("<u4").tobytes()
                        out.append((id_of(key), at, len(ids) // 4, zlib.crc32(ids), shard))
                        at += len(ids) // 4
                        if len(out) == 10_000:
                            yield rows_frame(out, columns, {"doc_id": "Int64"})
                            out = []
                    yield rows_frame(out, columns, {"doc_id": "Int64"})

    return listed.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def tokenised_tables(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the shards to the shared folder and read every one of them back."""
    folder = scratch(docs.sparkSession, "sst")
    return read_tables(write_tables(docs, folder, vocabulary, end_id), folder)
