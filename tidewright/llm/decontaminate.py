"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

Seeds are runs of min_match words that a document shares with a benchmark item. Pairs with seeds
are tiled: the longest common runs of words not yet marked are found by Karp-Rabin windows of
falling length and marked in both texts, so passages are found in any order. A pair counts if
the tiles cover enough of the item's words.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import stored

#: Slots of the filter that documents' runs pass before the seed join: 2 MB, whatever the benchmark's size.
SLOTS = 1 << 24
RUN_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(10).integers(0, 1 << 64, 256, dtype=_U)
_INWORD = np.multiply.accumulate(np.full(1 << 12, 0xD1342543DE82EF95, _U))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts and the text of each: runs of a-z, 0-9 and non-ASCII bytes, lower-cased."""
    low = [(t or b"").decode("utf-8", "replace").lower().encode() for t in texts]
    buf = np.frombuffer(b"\n".join([*low, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in low])
    inside = ((buf >= 97) & (buf <= 122)) | ((buf >= 48) & (buf <= 57)) | (buf >= 128)
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(begins):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    starts = np.searchsorted(at, begins)
    lens = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lens)
    h = np.add.reduceat(_TABLE[buf[at]] * _INWORD[place % len(_INWORD)], starts)
    return _mix(h), np.searchsorted(ends, begins, side="right")


def runs(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words, by first word; 0 where a run would leave its text."""
    out = np.zeros(len(h), _U)
    if n and len(h) >= n:
        acc = np.full(len(h) - n + 1, _U(n))
        for k in range(n):
            acc = acc * _U(_BASE) + h[k : len(h) - n + 1 + k]
        out[: len(acc)] = np.where(text[: len(acc)] == text[n - 1 :], _mix(acc) | _U(1), _U(0))
    return out


def tiles(p: np.ndarray, t: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of word hashes p and t: (start in p, start in t, length), lengths >= least.

    Always the longest run of words that are free in both is marked next, ties by its start in p,
    then in t. t may hold several stretches parted by 0, which matches nothing.
    """
    free_p, free_t = np.ones(len(p), bool), t != 0
    done: list[tuple[int, int, int]] = []

    def windows(x: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        if len(x) < s:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        up = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(s, _BASE, _U)]))
        blocked = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(blocked[s:] == blocked[:-s])
        h = np.zeros(len(at), _U)
        for k in range(s):
            h += x[at + k] * up[s - 1 - k]
        return at, h

    s = min(len(p), len(t))
    while s >= least and free_p.any():
        at_p, hp = windows(p, free_p, s)
        at_t, ht = windows(t, free_t, s)
        order = np.argsort(ht, kind="stable")
        lo, hi = np.searchsorted(ht[order], hp), np.searchsorted(ht[order], hp, side="right")
        waiting = []
        for i, a, b in zip(at_p.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for j in at_t[order[a:b]].tolist():
                if (i and j and free_p[i - 1] and free_t[j - 1] and p[i - 1] == t[j - 1]) or not np.array_equal(p[i : i + s], t[j : j + s]):
                    continue  # not the start of a run, or only the hashes agree
                n = s
                while i + n < len(p) and j + n < len(t) and free_p[i + n] and free_t[j + n] and p[i + n] == t[j + n]:
                    n += 1
                waiting.append((-n, i, j))
        heapq.heapify(waiting)
        while waiting:
            n, i, j = heapq.heappop(waiting)
            free = free_p[i : i - n] & free_t[j : j - n]
            if free.all():
                free_p[i : i - n] = free_t[j : j - n] = False
                done.append((i, j, -n))
                continue
            turns = np.flatnonzero(np.diff(free.astype(np.int8), prepend=0, append=0))
            for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
                if b - a >= s:  # what a longer tile left of this run
                    heapq.heappush(waiting, (a - b, i + a, j + a))
        s = s // 2 if s // 2 >= least else least if s > least else 0
    return sorted(done)


def _seed_filter(seeds: DataFrame) -> np.ndarray:
    """One bit a slot, set by the seeds' hashes; made of 256 rows of 8 KB."""

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, bool)
        bits[np.asarray(table.column("low"))] = True
        return pa.table({"high": table.column("high")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    slot = F.shiftrightunsigned("seed", 40)
    rows = seeds.select(F.shiftright(slot, 16).alias("high"), slot.bitwiseAND(F.lit(0xFFFF)).alias("low")).distinct()
    out = np.zeros((SLOTS >> 16, 1 << 13), np.uint8)
    for r in rows.groupBy("high").applyInArrow(pack, "high long, bits binary").toLocalIterator():
        out[r["high"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def tile_matches(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, tiles array<struct<item_start, n_words>>, text_hash) of pairs that reach coverage.

    coverage: share of the item's words that tiles of min_match words or more cover; an item of
    fewer words has to occur whole. Words are compared by 64-bit hashes. Null and empty texts have
    no words, and an item without words is in no document. Null or repeated ids: every row is
    judged by itself, repeated rows give a pair each, and repeated items count once. Whole texts
    are scanned, in runs of about 1 MB; only the stretches around shared runs travel on. Empty
    tables: empty result. Other columns of both tables are left out, so names can't clash.

    Candidates come from an item's rarest seeds: tiles of 5 words or more that cover c of n words
    hold ceil(c n / 5) of its seeds at least, so all but one fewer of its most frequent seeds have
    to be joined, and a run of words that many documents and items share is joined for none of
    them unless an item has little else.
    """
    spark = docs.sparkSession

    def item_rows(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            h, doc = words(texts)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            lists = [h[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
            seeds = [runs(x, np.zeros(len(x), np.int64), min(min_match, len(x))) for x in lists]
            yield pa.RecordBatch.from_pydict({"item_id": b.column(0), "words": pa.array([x.tobytes() for x in lists], pa.binary()), "n_words": pa.array([len(x) for x in lists], pa.int64()), "seeds": pa.array([s[s > 0].view(np.int64).tolist() for s in seeds], pa.list_(pa.int64()))})

    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("data")).distinct()
    items = stored(items.mapInArrow(item_rows, "item_id long, words binary, n_words long, seeds array<long>").where("n_words > 0").withColumn("item", F.xxhash64("item_id", "words")), "items")
    lengths = sorted({min_match, *(r[0] for r in items.select("n_words").where(F.col("n_words") < min_match).distinct().collect())})
    seeds = items.select("item", "n_words", F.explode("seeds").alias("seed")).groupBy("seed", "item", "n_words").agg(F.count("*").alias("times"))
    sent = spark.sparkContext.broadcast(_seed_filter(seeds))  # SLOTS bits

    def found_in(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, seed, words of the seed) of runs that may be a seed, by first word."""
        out = []
        for n in lengths:
            seed = runs(h, doc, n)
            slot = (seed >> _U(40)).astype(np.int64)
            hit = np.flatnonzero((seed > 0) & ((sent.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0))
            out.append((hit, seed[hit], np.full(len(hit), n)))
        at, seed, size = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], seed[order], size[order]

    def stretches(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            raw, size, start = b.column(1).to_pylist(), 0, 0
            for i, d in enumerate(raw):
                size += len(d or b"")
                if size < RUN_BYTES and i + 1 < len(raw):
                    continue
                h, doc = words(raw[start : i + 1])
                at, seed, long = found_in(h, doc)
                out = {k: [] for k in ("uid", "doc_id", "text_hash", "seeds", "stretch")}
                for mine in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc[at])) + 1) if len(at) else []:
                    row = start + int(doc[at[mine[0]]])
                    covered = np.unique(np.repeat(at[mine] - np.cumsum(long[mine]) + long[mine], long[mine]) + np.arange(long[mine].sum()))
                    parts = np.split(h[covered], np.flatnonzero(np.diff(covered) > 1) + 1)
                    out["uid"].append((part << 33) | n)
                    out["doc_id"].append(b.column(0)[row].as_py())
                    out["text_hash"].append(b.column(2)[row].as_py())
                    out["seeds"].append(np.unique(seed[mine]).view(np.int64).tolist())
                    out["stretch"].append(np.concatenate([x for p in parts for x in (p, np.zeros(1, _U))]).tobytes())
                    n += 1
                start, size = i + 1, 0
                if out["uid"]:
                    yield pa.RecordBatch.from_pydict({"uid": pa.array(out["uid"], pa.int64()), "doc_id": pa.array(out["doc_id"], pa.int64()), "text_hash": pa.array(out["text_hash"], pa.int64()), "seeds": pa.array(out["seeds"], pa.list_(pa.int64())), "stretch": pa.array(out["stretch"], pa.binary())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data"), F.xxhash64(F.col(text_col).cast("binary")).alias("text_hash"))
    near = stored(rows.mapInArrow(stretches, "uid long, doc_id long, text_hash long, seeds array<long>, stretch binary"), "stretches")
    often = near.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("n_docs"))
    rare_first = Window.partitionBy("item").orderBy(F.coalesce("n_docs", F.lit(0)), "seed").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("times").over(Window.partitionBy("item"))
    held = F.when(F.col("n_words") < min_match, 1).otherwise(F.ceil(F.col("n_words") * F.lit(coverage) / min_match))
    ranked = seeds.join(often, "seed", "left").select("seed", "item", "n_docs", (total - held + 1).alias("needed"), F.coalesce(F.sum("times").over(rare_first), F.lit(0)).alias("before"))
    wanted = ranked.where("before < needed AND n_docs IS NOT NULL").select("seed", "item")
    pairs = near.select("uid", F.explode("seeds").alias("seed")).join(wanted, "seed").select("uid", "item").distinct()
    both = pairs.join(near.select("uid", "doc_id", "text_hash", "stretch", F.col("seeds").alias("own")), "uid").join(items.select("item", "item_id", "words", "seeds"), "item").select("doc_id", "text_hash", "item_id", "stretch", "words", "own", "seeds")

    def tile(batches):
        for b in batches:
            out = {k: [] for k in ("coverage", "n_tiles", "tiles")}
            for t, p, own, seed in zip(*(b.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True):
                p = np.frombuffer(p, _U)
                least = min(min_match, len(p))
                # seeds that the document lacks cover nothing: pairs that can't reach the coverage end here
                may = least * int(np.isin(np.array(seed, np.int64), np.array(own, np.int64)).sum()) >= coverage * len(p)
                found = tiles(p, np.frombuffer(t, _U), least) if may else []
                out["coverage"].append(sum(x[2] for x in found) / len(p))
                out["n_tiles"].append(len(found))
                out["tiles"].append([{"item_start": i, "n_words": n} for i, _, n in found])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "item_id": b.column(2), "coverage": pa.array(out["coverage"], pa.float64()), "n_tiles": pa.array(out["n_tiles"], pa.int64()), "tiles": pa.array(out["tiles"], pa.list_(pa.struct([("item_start", pa.int64()), ("n_words", pa.int64())]))), "text_hash": b.column(1)})

    found = both.mapInArrow(tile, "doc_id long, item_id long, coverage double, n_tiles long, tiles array<struct<item_start:long,n_words:long>>, text_hash long")
    return found.where(F.col("coverage") >= coverage)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that reach the coverage with no item; all columns kept, whatever their names.

    Nulls, empty and long texts, ties, repeated rows and empty tables: as tile_matches judges them.
    """
    found = tile_matches(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("doc_id", "text_hash").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("binary")).alias("text"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text") == F.col("text_hash")), "left_anti").select("row.*")
