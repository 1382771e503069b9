"""Token ids in sorted-string-table shards: documents keyed by identifier.

Layout of a shard, all integers little-endian unless stated:

* blocks of up to ``BLOCK`` entries, each deflated as a whole. An entry: shared key bytes (1),
  own key bytes (1), own key bytes, width of an id in bytes (1: 2 or 4), number of ids (varint),
  the ids. Keys of a block share prefixes; the first key of a block is whole.
* sparse index: for each block its last key's length (1) and bytes, offset (8), stored bytes (4),
  entries (4).
* Bloom filter: bits / 8 bytes.
* footer of fixed size: magic, index offset, Bloom offset, number of blocks, entries, ids, bits,
  hashes, CRC-32 of index and filter.

A key is one byte (0 for a null identifier, else 1) and the identifier as 8 big-endian bytes
with the sign bit flipped, so that byte order is numeric order with nulls first.
"""

from __future__ import annotations

import math
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellframe.llm.shared import cut, shared_path, small_batches, whole_text

MAGIC = b"CFSST01\n"
FOOTER = struct.Struct("<8sQQQQQQII")
BLOCK = 64
#: A shard is closed when its blocks reach this many bytes.
SHARD_BYTES = 32 << 20
BITS_PER_KEY = 10


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & (1 << 64) - 1).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def bloom_bits(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % (1 << 64) % bits for i in range(hashes)]


class ShardWriter:
    """Takes entries in ascending key order; finish() has the whole file."""

    def __init__(self):
        self.blocks: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.block: list[bytes] = []
        self.last = b""
        self.size = self.ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        wide = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        self.block.append(bytes((shared, len(key) - shared)) + key[shared:] + bytes((wide,)) + varint(len(ids)) + ids.astype(f"<u{wide}").tobytes())
        self.keys.append(key)
        self.last, self.ids = key, self.ids + len(ids)
        if len(self.block) == BLOCK:
            self.close_block()

    def close_block(self) -> None:
        if self.block:
            stored = zlib.compress(b"".join(self.block), 1)
            self.index.append((self.last, self.size, len(stored), len(self.block)))
            self.blocks.append(stored)
            self.size += len(stored)
            self.block = []

    def finish(self) -> bytes:
        self.close_block()
        index = b"".join(bytes((len(k),)) + k + struct.pack("<QII", at, n, rows) for k, at, n, rows in self.index)
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 8) * 8)
        hashes = max(1, round(BITS_PER_KEY * math.log(2)))
        filled = bytearray(bits // 8)
        for k in set(self.keys):
            for b in bloom_bits(k, bits, hashes):
                filled[b >> 3] |= 1 << (b & 7)
        tail = FOOTER.pack(MAGIC, self.size, self.size + len(index), len(self.index), len(self.keys), self.ids, bits, hashes, zlib.crc32(index + filled))
        return b"".join([*self.blocks, index, filled, tail])


class ShardReader:
    """Reads a shard through a random-access file: footer, index and filter first, blocks as asked."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        magic, index_at, bloom_at, blocks, self.entries, self.ids, self.bits, self.hashes, crc = FOOTER.unpack(file.read_at(FOOTER.size, end - FOOTER.size))
        body = file.read_at(end - FOOTER.size - index_at, index_at)
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("not a whole shard")
        self.bloom = body[bloom_at - index_at :]
        self.index, p = [], 0
        for _ in range(blocks):
            n = body[p]
            self.index.append((body[p + 1 : p + 1 + n], *struct.unpack_from("<QII", body, p + 1 + n)))
            p += 17 + n

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, stored, rows = self.index[k]
        data, p, key = zlib.decompress(self.file.read_at(stored, at)), 0, b""
        for _ in range(rows):
            shared, own = data[p], data[p + 1]
            key = key[:shared] + data[p + 2 : p + 2 + own]
            p += 2 + own
            wide, n, shift, p = data[p], 0, 0, p + 1
            while True:
                n |= (data[p] & 127) << shift
                shift, p = shift + 7, p + 1
                if data[p - 1] < 128:
                    break
            yield key, np.frombuffer(data, f"<u{wide}", n, p)
            p += wide * n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every entry of that identifier: filter, binary search in the index, then blocks."""
        key = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bloom_bits(key, self.bits, self.hashes)):
            return []
        found, k = [], bisect_left(self.index, key, key=lambda x: x[0])
        while k < len(self.index):
            found += [ids for x, ids in self.block(k) if x == key]
            if self.index[k][0] > key:
                break
            k += 1
        return found


def write_shards(docs: DataFrame, path: str, encode: str, end_id: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes ``docs`` and writes shards below ``path``; returns one row for each shard.

    Documents are range partitioned and sorted by identifier (null first, equal ones by text),
    so shard names in order hold identifiers in order. ``end_id`` is added to each document.
    A null text counts as empty; repeated rows are repeated entries; an empty table writes no
    shard; other columns are not stored. A retried task writes the same names again: a shard is
    written aside and then moved into place.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), whole_text(text).alias("t"))
    rows = rows.repartitionByRange("k").sortWithinPartitions("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cellframe.llm.bpe import encoder

        e, (fs, root) = encoder(encode), pyarrow.fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        fs.create_dir(root, recursive=True)
        w, done = ShardWriter(), []

        def close() -> None:
            nonlocal w
            if w.keys:
                name = f"{root}/part-{task.partitionId():07d}-{len(done):05d}.sst"
                with fs.open_output_stream(aside := f"{name}.{task.taskAttemptId()}") as f:
                    f.write(w.finish())
                fs.move(aside, name)
                done.append((name.rpartition("/")[2], len(w.keys), w.ids))
            w = ShardWriter()

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = e.encode(t)
                w.add(key_of(k), ids if end_id is None else np.append(ids, end_id))
                if w.size >= SHARD_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["shard", "entries", "ids"])

    small_batches(docs.sparkSession)
    return cut(rows.mapInArrow(run, "shard string, entries long, ids long"))


def read_shards(shards: DataFrame, path: str) -> DataFrame:
    """Entries of the shards that write_shards() returned: doc_id, start, ids.

    ``start`` is the number of ids before the document over all shards in order, ``ids`` its
    ids as little-endian unsigned 32-bit integers. The running total is over one row a shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    at = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    at = at.repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    out: tuple[list, list, list] = ([], [], [])
                    for doc, ids in ShardReader(f).scan():
                        for c, v in zip(out, (doc, start, ids.astype("<u4").tobytes()), strict=True):
                            c.append(v)
                        start += len(ids)
                        if len(out[0]) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc_id", "start", "ids"])
                            out = ([], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc_id", "start", "ids"])

    return at.mapInArrow(run, "doc_id long, start long, ids binary")


def lookup(spark: SparkSession, path: str, shard: str, doc_id: int | None) -> list[np.ndarray]:
    """Ids of one document from one shard, by binary search."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(f"{root}/{shard}") as f:
        return ShardReader(f).lookup(doc_id)


def token_store(docs: DataFrame, encode: str, end_id: int) -> DataFrame:
    """Writes ``docs`` into shards in the shared folder and returns what they hold."""
    path = shared_path(docs.sparkSession, "token-shards")
    return read_shards(write_shards(docs, path, encode, end_id), path)
