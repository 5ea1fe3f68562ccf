"""Removal of byte strings that repeat anywhere in the corpus, over a blockwise suffix order.

The order of suffixes is only needed to ``length`` bytes: two suffixes count as equal when they
share that many. Construction follows the difference-cover scheme, block by block:

1. Documents are packed once into blocks of a few MB (a written table). Positions p with
   p mod v in the difference cover D form the cover sample. For any two positions i, j some
   delta < v puts both i+delta and j+delta into the sample, so two equal strings of ``length``
   bytes hold equal sample strings of ``length - v + 1`` bytes at the same offset.
2. Sample strings are ranked: each bucket of ranks is sorted by itself, and samples whose rank
   another sample shares are the long ties.
3. Only suffixes within v bytes before such a tie can equal another suffix. They are dealt to
   suffix buckets, and one bucket is sorted at a time; equal neighbours may be repeats.
4. Those few are dealt and sorted once more, by that fingerprint and a second, independent one
   together: 128 bits say what is equal, so strings that one fingerprint takes for equal stay.

The order within a bucket is that of fingerprints of the strings, not of the strings; for finding
equal ones any total order serves. The first sorts compare only so many bits (40 up to some
30 GB) that few strings pass by chance, as the last one decides. Keys travel sorted, as
differences, one binary value for a block and bucket, and what comes back is one bit a key; so
shuffles hold about three bytes a suffix and fourteen a repeat, a task holds one block or one
bucket, and text is never shuffled. A string frequent in a block is sent once by that block, so
hot strings don't make hot buckets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import id_and_bytes, opened, scratch, stored

#: A perfect difference set modulo 133 (every residue is a difference of two members).
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)

BLOCK_BYTES = 4 << 20
CHUNK = 1 << 20
KEYS_PER_BUCKET = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_U = np.uint64


def difference_cover(length: int) -> tuple[int, tuple[int, ...]]:
    """(v, D) for a string length: the perfect set from 150 bytes on, else a square-root cover."""
    if length >= PERIOD + 17:
        return PERIOD, COVER
    v = max(1, length // 2)
    r = max(1, math.isqrt(v))
    return v, tuple(sorted({*range(r), *range(0, v, r), v - 1}))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, _U)
    p[0] = 1
    return np.multiply.accumulate(p)


class _Fingerprints:
    """64-bit fingerprints of the strings of a given length at many positions of a buffer; two that differ in their random numbers for bytes."""

    def __init__(self, longest: int):
        n = CHUNK + longest + 1
        self.up, self.down = _powers(_MULTIPLIER, n), _powers(pow(_MULTIPLIER, -1, 1 << 64), n)
        self.tables = np.random.default_rng(20).integers(0, 1 << 64, (2, 256), dtype=_U)

    def at(self, buf: np.ndarray, pos: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        out = np.empty(len(pos), _U)
        for lo in range(0, len(buf), CHUNK):
            i, j = np.searchsorted(pos, (lo, lo + CHUNK))
            if i == j:
                continue
            part = self.tables[which][buf[lo : lo + CHUNK + length]]
            part *= self.down[: len(part)]
            sums = np.zeros(len(part) + 1, _U)
            np.cumsum(part, out=sums[1:])
            at = pos[i:j] - lo
            out[i:j] = (sums[at + length] - sums[at]) * self.up[at]
        out ^= out >> _U(32)
        out *= _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
        return out


def _deltas(keys: np.ndarray) -> bytes:
    """Sorted keys in two to three bits more each than the logarithm of their mean distance: differences of the leading bits in unary, whole half bytes of the rest as they are."""
    n = len(keys)
    gap = int(keys[-1]) // n
    low = gap.bit_length() // 4 * 4
    low = min(60, low + 4) if (gap >> low) + low > low + 4 + (gap >> (low + 4)) else low
    high = (keys >> _U(low)).astype(np.int64)
    high += np.arange(n)
    unary = np.zeros(int(high[-1]) + 1, bool)
    unary[high] = True
    octets, half = divmod(low, 8)
    raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)
    halves = np.zeros(n + n % 2 if half else 0, np.uint8)
    if half:
        halves[:n] = raw[:, octets] & 15
    return bytes([low]) + n.to_bytes(4, "little") + raw[:, :octets].tobytes() + (halves[::2] | halves[1::2] << 4).tobytes() + np.packbits(unary).tobytes()


def _keys(blob: bytes) -> np.ndarray:
    low, n = blob[0], int.from_bytes(blob[1:5], "little")
    (octets, half), raw = divmod(low, 8), np.zeros((n, 8), np.uint8)
    at = 5 + n * octets
    raw[:, :octets] = np.frombuffer(blob, np.uint8, n * octets, 5).reshape(n, octets)
    if half:
        halves = np.frombuffer(blob, np.uint8, (n + 1) // 2, at)
        raw[::2, octets], raw[1::2, octets] = halves & 15, halves[: n // 2] >> 4
        at += len(halves)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=at)).view(bool))
    high -= np.arange(n)
    return high.view(_U) << _U(low) | raw.view("<u8").ravel()


class _Deal:
    """Sorted distinct keys of a block, dealt to buckets by their leading bits."""

    def __init__(self, prints: np.ndarray, bits: int, bucket_bits: int):
        # a key that the block itself repeats is a repeat already, but is still sent once for others
        self.keys, self.where, count = np.unique(prints >> _U(64 - bits), return_inverse=True, return_counts=True)
        self.own = count > 1
        self.rest = _U(bits - bucket_bits)
        bucket = (self.keys >> self.rest).astype(np.int64)
        self.starts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
        self.stops = np.append(self.starts, len(bucket))[1:]
        self.buckets = bucket[self.starts]

    def rows(self) -> Iterator[tuple[int, bytes]]:
        low = self.keys & ((_U(1) << self.rest) - _U(1))
        for b, i, j in zip(self.buckets, self.starts, self.stops, strict=True):
            yield int(b), _deltas(low[i:j])

    def repeated(self, bitmaps: dict[int, bytes]) -> np.ndarray:
        """For each position: whether its key occurs again, by the bits that came back."""
        hit = self.own.copy()
        for b, i, j in zip(self.buckets, self.starts, self.stops, strict=True):
            if (bits := bitmaps.get(int(b))) is not None:
                hit[i:j] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i).astype(bool)
        return hit[self.where]


class _Pairs(_Deal):
    """Sorted distinct pairs of fingerprints of a block, dealt to buckets by the leading bits of the first."""

    def __init__(self, first: np.ndarray, second: np.ndarray, bucket_bits: int):
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.cumsum(new) - 1
        self.where = np.empty(len(a), np.int64)
        self.where[order] = group
        self.keys, self.second, self.own = a[new], b[new], np.bincount(group, minlength=int(new.sum())) > 1
        # a shift by all 64 bits is none
        self.rest = _U(63 - bucket_bits)
        bucket = (self.keys >> _U(1) >> self.rest).astype(np.int64)
        self.starts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
        self.stops = np.append(self.starts, len(bucket))[1:]
        self.buckets = bucket[self.starts]

    def rows(self) -> Iterator[tuple[int, bytes]]:
        # the bucket's own bits are left out, as in _Deal
        low = self.keys & (~_U(0) >> (_U(63) - self.rest))
        for b, i, j in zip(self.buckets, self.starts, self.stops, strict=True):
            yield int(b), _U(j - i).tobytes() + self.second[i:j].tobytes() + _deltas(low[i:j])


def _read_pairs(blob: bytes) -> np.ndarray:
    """The pairs of a blob, a row each, without the bits of their bucket."""
    n = int(np.frombuffer(blob, _U, 1)[0])
    return np.stack([_keys(blob[8 + 8 * n :]), np.frombuffer(blob, _U, n, 8)], axis=1)


def _tied(keys: np.ndarray) -> np.ndarray:
    """Which keys (numbers, or rows of two) occur again."""
    order = np.argsort(keys, kind="stable") if keys.ndim == 1 else np.lexsort((keys[:, 1], keys[:, 0]))
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    same = same if keys.ndim == 1 else same.all(axis=1)
    tie = np.zeros(len(keys), bool)
    tie[order[1:][same]] = True
    tie[order[:-1][same]] = True
    return tie


def _sort_bucket(table: pa.Table, read=_keys) -> pa.Table:
    """Sorts one bucket; returns for each block that sent keys the bits of those found again."""
    blocks, blobs = table.column("block").to_pylist(), table.column("blob").to_pylist()
    lists = [read(b) for b in blobs]
    tie, out, at = _tied(np.concatenate(lists)), [], 0
    for block, part in zip(blocks, lists, strict=True):
        mine = tie[at : at + len(part)]
        at += len(part)
        if mine.any():
            out.append((block >> 32, block, np.packbits(mine).tobytes()))
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"part": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([x[1] for x in out], pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int64()), "bits": pa.array([x[2] for x in out], pa.binary())})


def _sort_pairs(table: pa.Table) -> pa.Table:
    return _sort_bucket(table, _read_pairs)


_BITS = "part long, block long, bucket long, bits binary"


class _Block:
    """A block read back: buffer, document bounds, and the steps that each pass repeats alike."""

    def __init__(self, row: dict, length: int, copies: dict[int, bool]):
        self.buf = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
        self.ids, self.null_id = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["null_ids"], np.uint8)
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.copies = copies  # ordinal of a text that occurs again -> whether this row stands for it
        self.length = length
        self.v, cover = difference_cover(length)
        self.in_cover = np.zeros(self.v, bool)
        self.in_cover[list(cover)] = True
        self.live = np.array([copies.get(k, True) for k in range(len(self.lens))], bool) & (self.lens >= length)

    def _positions(self, length: int, sample: bool) -> np.ndarray:
        found = []
        for s, e in zip(self.starts[self.live], self.ends[self.live], strict=True):
            n = e - s - length + 1
            found.append(s + (np.flatnonzero(self.in_cover[np.arange(n) % self.v]) if sample else np.arange(n)))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def samples(self, prints: _Fingerprints) -> tuple[np.ndarray, np.ndarray]:
        short = self.length - self.v + 1
        pos = self._positions(short, True)
        return pos, prints.at(self.buf, pos, short)

    def suffixes(self, prints: _Fingerprints, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions with a tied sample at most v-1 bytes on, and their fingerprints."""
        before = np.zeros(len(self.buf) + self.v + 1, np.int32)
        before[ties + 1] = 1
        before = np.cumsum(before, dtype=np.int32)
        pos = self._positions(self.length, False)
        pos = pos[before[pos + self.v] > before[pos]]
        return pos, prints.at(self.buf, pos, self.length)


def _bits_of(path: str, part: int) -> dict[int, dict[int, bytes]]:
    """block -> bucket -> bits, for the blocks that one packing task wrote; reads that folder alone."""
    fs, root = opened(f"{path}/part={part}")
    if fs.get_file_info(root).type == pafs.FileType.NotFound:
        return {}
    found: dict[int, dict[int, bytes]] = {}
    for b in pads.dataset(root, filesystem=fs, format="parquet").to_batches(columns=["block", "bucket", "bits"]):
        for block, bucket, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found.setdefault(block, {})[bucket] = bits
    return found


def _blocks(batches, length: int, *paths: str):
    part, bits = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            if row["part"] != part:
                part, bits = row["part"], [_bits_of(p, row["part"]) for p in paths]
            mine = [b.get(row["block"], {}) for b in bits]
            copies = np.frombuffer(mine[0].get(0, b""), np.int64) if mine else []
            block = _Block(row, length, {int(c) >> 1: bool(c & 1) for c in copies})
            yield row["block"], block, mine[1:]


def _pack(batches, block_bytes: int):
    part, n = TaskContext.get().partitionId(), 0
    held, size = [], 0

    def row():
        ids = np.array([i if i is not None else 0 for i, _ in held], np.int64)
        places: dict[bytes, list[int]] = {}
        for k, (_, d) in enumerate(held):
            places.setdefault(hashlib.blake2b(d, digest_size=16).digest(), []).append(k)
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int64()), "block": pa.array([(part << 32) | n], pa.int64()), "size": pa.array([size], pa.int64()),
            "ids": [ids.tobytes()], "null_ids": [bytes(int(i is None) for i, _ in held)],
            "lens": [np.array([len(d) for _, d in held], np.int64).tobytes()],
            "texts": pa.array([[{"digest": d, "places": p} for d, p in places.items()]], pa.list_(pa.struct([("digest", pa.binary()), ("places", pa.list_(pa.int32()))]))),
            "data": [zstandard.compress(b"".join(d for _, d in held), 1)],
        })

    for batch in batches:
        for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            d = d or b""
            if held and size + len(d) > block_bytes:
                yield row()
                held, size, n = [], 0, n + 1
            held.append((i, d))
            size += len(d)
    if held:
        yield row()


_PACKED = "part long, block long, size long, ids binary, null_ids binary, lens binary, texts array<struct<digest:binary,places:array<int>>>, data binary"


def remove_repeats(docs: DataFrame, length: int = 200, block_bytes: int = BLOCK_BYTES, key_bits: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary), one row for each row of docs.

    spans: maximal runs of removed bytes, in bytes of the text. Null text: empty. Repeated rows
    and rows with a null or repeated doc_id are separate texts, so both lose what they share.
    Strings never cross documents. Texts shorter than length are kept whole; a text longer than a
    block is a block of its own. An empty table gives an empty result. Other columns are left
    out, so names can't clash. Strings count as equal if two independent 64-bit fingerprints are;
    key_bits: what the first sort of suffixes compares of one, by default enough that at most one
    in 32 of those sent is equal by chance; the second sort decides.
    """
    spark = docs.sparkSession
    packed = stored(id_and_bytes(docs).mapInArrow(lambda it: _pack(it, block_bytes), _PACKED), "packed")
    total = packed.agg(F.sum("size")).first()[0] or 0
    v, cover = difference_cover(length)
    samples = max(1, total * len(cover) // v)
    key_bits = key_bits or min(62, max(40, math.ceil(math.log2(max(1, total))) + 5))

    def bucket_bits(keys: int) -> int:
        return max(0, math.ceil(math.log2(max(1, keys / KEYS_PER_BUCKET))))

    # texts that occur again as a whole: one of them stands for all in the passes below
    # a block lists its distinct texts, so a text of many copies is one row a block here
    each = packed.select("part", "block", F.explode("texts").alias("t")).select("part", "block", "t.digest", "t.places")
    groups = each.groupBy("digest").agg(F.sum(F.size("places")).alias("n"), F.min(F.struct("block", F.col("places")[0].alias("k"))).alias("first")).where("n > 1")
    stands = lambda k: (F.col("block") == F.col("first.block")) & (k == F.col("first.k"))
    copies = each.join(groups, "digest").select("part", "block", F.transform("places", lambda k: (k * 2 + F.when(stands(k), 1).otherwise(0)).cast("long")).alias("codes"))

    def as_bits(batches):
        for b in batches:
            codes = [np.array(x, np.int64).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"part": b.column(0), "block": b.column(1), "bucket": pa.array([0] * b.num_rows, pa.int64()), "bits": pa.array(codes, pa.binary())})

    copies = copies.groupBy("part", "block").agg(F.flatten(F.collect_list("codes")).alias("codes")).mapInArrow(as_bits, _BITS)

    def kept_bits(df: DataFrame, name: str) -> str:
        path = scratch(spark, name)
        df.repartition("part").write.partitionBy("part").parquet(path)
        return path

    at_copies = kept_bits(copies, "copies")
    plain = packed.drop("texts")
    rank_bucket, rank_bits = bucket_bits(samples), min(62, max(40, math.ceil(math.log2(samples)) + 8))

    def send_samples(batches):
        prints = _Fingerprints(length)
        for block, b, _ in _blocks(batches, length, at_copies):
            yield from _sent(block, _Deal(b.samples(prints)[1], rank_bits, rank_bucket))

    def sort(sent: DataFrame, name: str, by=_sort_bucket) -> str:
        return kept_bits(sent.groupBy("bucket").applyInArrow(lambda t: by(t), _BITS), name)

    _SENT = "bucket long, block long, blob binary"
    at_ranks = sort(plain.mapInArrow(send_samples, _SENT), "ranks")
    suffix_bucket = bucket_bits(total // 4)

    def suffixes(b: _Block, prints: _Fingerprints, ranks: dict[int, bytes]) -> tuple[np.ndarray, _Deal]:
        pos, keys = b.samples(prints)
        ties = pos[_Deal(keys, rank_bits, rank_bucket).repeated(ranks)]
        pos, keys = b.suffixes(prints, ties)
        return pos, _Deal(keys, key_bits, min(key_bits, suffix_bucket))

    def send_suffixes(batches):
        prints = _Fingerprints(length)
        for block, b, (ranks,) in _blocks(batches, length, at_copies, at_ranks):
            yield from _sent(block, suffixes(b, prints, ranks)[1])

    at_suffixes = sort(plain.mapInArrow(send_suffixes, _SENT), "suffixes")

    def pairs(b: _Block, prints: _Fingerprints, ranks: dict[int, bytes], found: dict[int, bytes]) -> tuple[np.ndarray, _Pairs]:
        pos, deal = suffixes(b, prints, ranks)
        pos = pos[deal.repeated(found)]
        del deal  # a few numbers a suffix, which the pairs don't need
        return pos, _Pairs(prints.at(b.buf, pos, length), prints.at(b.buf, pos, length, 1), suffix_bucket)

    def send_pairs(batches):
        prints = _Fingerprints(length)
        for block, b, (ranks, found) in _blocks(batches, length, at_copies, at_ranks, at_suffixes):
            yield from _sent(block, pairs(b, prints, ranks, found)[1])

    at_pairs = sort(plain.mapInArrow(send_pairs, _SENT), "pairs", _sort_pairs)

    def finish(batches):
        prints = _Fingerprints(length)
        for _, b, (ranks, found, sure) in _blocks(batches, length, at_copies, at_ranks, at_suffixes, at_pairs):
            pos, deal = pairs(b, prints, ranks, found)
            pos = pos[deal.repeated(sure)]
            edge = np.zeros(len(b.buf) + 1, np.int32)
            edge[pos] += 1
            edge[pos + length] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            spans, kept = [], []
            for k, (s, e) in enumerate(zip(b.starts, b.ends, strict=True)):
                if k in b.copies and e - s >= length:
                    spans.append([{"start": 0, "end": int(e - s)}])
                    kept.append(b"")
                    continue
                mine = gone[s:e]
                turn = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": int(i), "end": int(j)} for i, j in zip(turn[::2], turn[1::2], strict=True)])
                kept.append(b.buf[s:e][~mine].tobytes() if len(turn) else b.buf[s:e].tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(b.ids, mask=b.null_id.astype(bool)), "n_bytes": pa.array(b.lens),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
            })

    return plain.mapInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _sent(block: int, deal: _Deal):
    rows = list(deal.rows())
    if rows:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def digest(df: DataFrame) -> DataFrame:
    """The columns of the registered query, from what remove_repeats returns."""
    return df.select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
