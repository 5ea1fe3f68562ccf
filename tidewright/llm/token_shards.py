"""Token ids in sorted-string-table shards.

File format, all numbers little-endian. Blocks come first, each zstd-compressed: entries of
``shared u8, own u8, size u32, key bytes [shared:], value``, where shared is the length of the
prefix that the key has in common with the key before it (0 at a block's start). Then the sparse
index, one entry a block: ``key, offset u64, length u32`` with the block's first key; then a
Bloom filter over the ids; then the footer of fixed size. Keys are 13 bytes: 0 or 1 for a null
or given id, the id as big-endian with its sign bit flipped, and a big-endian count of equal ids
before it. Values are token ids of ``width`` bytes. Shards are ranges of ids, in order.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm import tokens
from tidewright.llm.common import id_and_bytes, opened, scratch, sliced, stored

MAGIC = b"TWSST001"
_ENTRY, _INDEX, _FOOTER = struct.Struct("<BBI"), struct.Struct("<13sQI"), struct.Struct("<QQQQQQB8s")
BLOCK_BYTES = 1 << 16
SHARD_BYTES = 32 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None, again: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is not None, ((doc_id or 0) + (1 << 63)), again)


def id_of(key: bytes) -> int | None:
    given, n, _ = struct.unpack(">BQI", key)
    return n - (1 << 63) if given else None


def _slots(keys: list[bytes], bits: int) -> np.ndarray:
    """Positions in the filter of each key's id: double hashing of one 64-bit digest."""
    h = np.array([xxhash.xxh64_intdigest(k[:9]) for k in keys], np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


class Writer:
    """Writes entries in key order to an open file, one block in memory at a time."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.index, self.keys, self.size, self.n, self.tokens = [], [], [], 0, 0, 0
        self.last = b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.index.append([key, self.at, 0])
        self.block.append(_ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value)
        self.size += len(self.block[-1])
        self.last, self.n, self.tokens = key, self.n + 1, self.tokens + len(value) // self.width
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = zstandard.compress(b"".join(self.block), 1)
            self.out.write(data)
            self.index[-1][2] = len(data)
            self.at += len(data)
            self.block, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(_INDEX.pack(*x) for x in self.index)
        bits = np.zeros(max(64, -(-self.n * BLOOM_BITS // 8) * 8), bool)
        if self.keys:
            bits[_slots(self.keys, len(bits)).ravel()] = True
        bloom = np.packbits(bits).tobytes()
        self.out.write(index + bloom)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.n, self.tokens, self.width, MAGIC))


@dataclass
class Shard:
    """A reader: footer, index and filter are loaded; blocks are read when asked for."""

    fs: pafs.FileSystem
    path: str

    def __post_init__(self):
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        at, n_index, at_bloom, n_bloom, self.n, self.tokens, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{self.path} is no shard")
        self.index = list(_INDEX.iter_unpack(self._read(at, n_index)))
        self.bloom = np.unpackbits(np.frombuffer(self._read(at_bloom, n_bloom), np.uint8))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int):
        _, at, n = self.index[i]
        data, p, last = zstandard.decompress(self._read(at, n)), 0, b""
        while p < len(data):
            shared, own, size = _ENTRY.unpack_from(data, p)
            p += _ENTRY.size
            last = last[:shared] + data[p : p + own]
            p += own
            yield last, data[p : p + size]
            p += size

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def scan(self):
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Token ids of the rows with this id: filter, binary search in the index, then one block or a few."""
        key = key_of(doc_id)
        if not self.bloom[_slots([key], len(self.bloom))[0]].all():
            return []
        found = []
        i = max(0, bisect_right(self.index, key, key=lambda x: x[0]) - 1)
        while i < len(self.index) and self.index[i][0][:9] <= key[:9]:
            found += [self.ids(v) for k, v in self.block(i) if k[:9] == key[:9]]
            i += 1
        return found


def write_shards(docs: DataFrame, path: str, end_id: int, folder: str | None = None, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and writes shards; returns the manifest (shard, file, n_docs, n_tokens, first_id, last_id).

    path: a tokenizer file of any kind that ``tokens`` loads, on every executor. Ids are those of
    the library for whole texts, then end_id. Null text: only end_id. Null ids come first.
    Repeated ids and repeated rows are all kept, in an order that follows from their texts. The
    range of a shard is over (id, digest of the text), so rows of one id may spread over several
    shards and none grows with a hot id. A task writes to a name of its own, and only files that
    the manifest names count, so a task that is lost or run twice leaves nothing wrong. Empty
    table: an empty manifest. Other columns of docs are left out, so names can't clash. folder: a
    URI in a store that executors share and that pyarrow opens (file, hdfs, s3, gs; s3a is taken
    for s3); default: the session's shared folder.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "shards")
    fs, at = opened(folder)
    fs.create_dir(at, recursive=True)
    rows = id_and_bytes(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    ranged = rows.withColumn("h", F.xxhash64("data")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "data")

    def run(batches):
        shard = TaskContext.get().partitionId()
        width = 2 if max(tokens.vocab_size(path), end_id + 1) <= 1 << 16 else 4
        kind = f"<u{width}"
        end = np.array([end_id], kind).tobytes()
        fs, root = opened(folder)
        name = f"{root}/{shard:06d}-{uuid.uuid4().hex}.sst"
        writer = again = None
        first = last = None
        for b in sliced(batches):
            for doc_id, value in zip(b.column(0).to_pylist(), tokens.ids(path, b.column(1).to_pylist(), kind), strict=True):
                if writer is None:
                    out = fs.open_output_stream(name)
                    writer, again = Writer(out, width), 0
                else:
                    again = again + 1 if doc_id == last else 0
                first, last = doc_id if first is None else first, doc_id
                writer.add(key_of(doc_id, again), value + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [f"{folder}/{name.rsplit('/', 1)[-1]}"], "n_docs": pa.array([writer.n], pa.int64()), "n_tokens": pa.array([writer.tokens], pa.int64()), "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64())})

    return stored(ranged.select("doc_id", "data").mapInArrow(run, "shard long, file string, n_docs long, n_tokens long, first_id long, last_id long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of unsigned 32-bit numbers), read from the files in parallel.

    start: tokens of all documents before this one, in shard and key order; the totals come from
    the manifest, which has one row a shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    at = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"), "shard")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(*opened(file))
                for i in range(len(shard.index)):
                    rows = [(id_of(k), shard.ids(v).astype("<u4")) for k, v in shard.block(i)]
                    lens = np.array([len(v) for _, v in rows], np.int64)
                    starts = start + np.cumsum(lens) - lens
                    start += int(lens.sum())
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "start": pa.array(starts), "n_tokens": pa.array(lens), "ids": pa.array([v.tobytes() for _, v in rows], pa.binary())})

    return at.repartition(n, "file").select("file", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def find(manifest: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, tokens binary): rows of the wanted ids, each looked up in the shards whose range holds it.

    The span of all ids is cut into about as many even cells as there are shards; a shard lies in
    the cells that its range meets, an id in one, so the range join is an equality join on the
    cell. A task opens a shard once for its ids, and the filter spares blocks of ids that are
    missing. Null ids find nothing; repeats are asked once; empty tables give an empty result.
    """
    want = ids.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    given = manifest.where("last_id is not null")
    lo, hi, n = given.agg(F.min("first_id"), F.max("last_id"), F.count("*")).first()
    lo, cell = lo or 0, ((hi or 0) - (lo or 0)) // max(1, n) + 1
    # far apart: halves as doubles, so that the difference of two longs can't overflow; still in order
    place = lambda c: F.floor((F.col(c) / 2 - F.lit(lo / 2)) / F.lit(cell / 2)) if abs(lo) > 1 << 52 or cell > 1 << 52 else F.floor((F.col(c) - F.lit(lo)) / F.lit(cell))
    cells = given.select("file", "first_id", "last_id", F.explode(F.sequence(place("first_id"), place("last_id"))).alias("cell"))
    dealt = want.where(F.col("doc_id").between(lo, hi if hi is not None else lo)).withColumn("cell", place("doc_id")).join(cells, "cell").where("doc_id between first_id and last_id").select("file", "doc_id").distinct()

    def run(table: pa.Table) -> pa.Table:
        shard = Shard(*opened(table.column("file")[0].as_py()))
        rows = [(i, v.astype("<u4").tobytes()) for i in table.column("doc_id").to_pylist() for v in shard.get(i)]
        return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "tokens": pa.array([r[1] for r in rows], pa.binary())})

    return dealt.groupBy("file").applyInArrow(run, "doc_id long, tokens binary")


def digest(read: DataFrame) -> DataFrame:
    """The columns of the registered query, from what read_shards returns."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
