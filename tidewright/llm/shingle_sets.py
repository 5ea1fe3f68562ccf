"""The exact half of op6 for a similarity: Jaccard of word shingles, for pairs that few fingerprint bits don't reach.

Texts are sets of 64-bit shingle hashes. All sets are sorted by one order (shingles that a sample
finds in many texts last, else by hash); two sets of n <= m members whose similarity reaches s
share a member among the first n - ceil(s n) + 1 of the one and m - ceil(s m) + 1 of the other,
and n >= s m. So an equality join on these prefixes loses no pair, whatever the sample. Sets that
links found before connect are not paired again. Each set has a bitmap of parities of its members'
low bits: two bitmaps differ in no more bits than the sets differ in members, which rules out most
pairs without loss. The members of a key with many are compared by their bitmaps in blocks, and
only pairs that may reach the similarity leave a task: first each set's nearest of another
component, then, with the components that this gives, all. Every pair is verified on whole sets.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import components, id_and_bytes, regrouped, sliced, stored

#: Members of a key that are paired with each other at once; keys of more go through again, BLOCK members against BLOCK.
DIRECT, BLOCK = 16, 4096
#: Prefix members that a task sorts at once.
PER_TASK = 1_000_000
#: Texts that are sampled for frequent shingles, shingles held, and texts of the sample that make one frequent.
SAMPLE, HEAVY, FREQUENT = 20_000, 200_000, 2
#: Most bits of a bitmap; a set has about a bit a member.
MOST_BITS = 1 << 16
#: Members of a key in one row of what goes through again.
RUN = 1 << 15
_ENTRY = np.dtype([("key", "<u8"), ("fp", "<u8"), ("root", "<u8"), ("n", "<u4")])
SEED = 42


def shingle_set(data: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles: A-Z lowered, words parted by ASCII white space; fewer words: one shingle; none: empty."""
    tokens = (data or b"").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    text = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(text[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist() or [len(text)], strict=False)], np.uint64))


def majority(hashes: list[np.ndarray]) -> int:
    """The 64 bits that over half of all hashes have."""
    bits, n = np.zeros(64, np.int64), 0
    for h in hashes:
        bits += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(bits * 2 > n, bitorder="little").tobytes(), "little")


def _name(members: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(members.tobytes(), SEED)


def parities(members: np.ndarray) -> bytes:
    """Bit i: whether an odd number of members ends in the bits of i. XOR of its halves is the bitmap of half the size."""
    size = min(MOST_BITS, max(64, 1 << (len(members) - 1).bit_length()))
    odd = np.bincount((members & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_reach(n: int, x: bytes, m: int, y: bytes, similarity: Fraction) -> bool:
    """False only for sets of n and m members whose bitmaps x and y show a lower similarity."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) if len(v) > size else v for v in (x, y))
    apart = int(np.bitwise_count(x ^ y).sum())
    return (n + m - apart) * similarity.denominator >= (n + m + apart) * similarity.numerator


def frequent(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of shingles that occur in several texts of a sample of fixed size; only the order of sets rests on it."""
    share = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(share)) == 0)

    def run(batches):
        for b in sliced(batches):
            found = [shingle_set(d, words) for d in b.column(1).to_pylist()]
            h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counts = id_and_bytes(sample, id_col, text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(HEAVY).toArrow()
    h, n = np.array(top.column("h"), np.int64).view(np.uint64), np.array(top.column("n"), np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(docs: DataFrame, similarity: Fraction, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, n, prefix, bits, print long): fp names the set (equal sets have equal names), print is its SimHash."""
    heavy, counts = frequent(docs, words, id_col, text_col)

    def prefix(members: np.ndarray) -> bytes:
        rank = np.zeros(len(members), np.int64)
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, members), len(heavy) - 1)
            rank = np.where(heavy[at] == members, counts[at], 0)
        n = len(members)
        first = n + (-similarity.numerator * n // similarity.denominator) + 1 if n else 0
        return members[np.lexsort((members, rank))[:first]].tobytes()

    def run(batches):
        for b in sliced(batches):
            found = [shingle_set(d, words) for d in b.column(1).to_pylist()]
            prints = np.array([majority([x]) for x in found], np.uint64)
            names = np.array([_name(x) for x in found], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names.view(np.int64)), pa.array([len(x) for x in found], pa.int64()), pa.array([prefix(x) for x in found], pa.binary()), pa.array([parities(x) for x in found], pa.binary()), pa.array(prints.view(np.int64))], ["doc_id", "fp", "n", "prefix", "bits", "print"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long, n long, prefix binary, bits binary, print long")


def _near_lengths(n: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: Fraction) -> np.ndarray:
    return np.minimum(n[a], n[b]) * similarity.denominator >= np.maximum(n[a], n[b]) * similarity.numerator


def _pairs(n: np.ndarray, left: np.ndarray, similarity: Fraction, roots: np.ndarray):
    """Arrays of positions (a, b): rows by run and n, left = members after a row in its run; those of equal root are left out."""
    idx, d = np.flatnonzero(left > 0), 1
    while len(idx):
        near = _near_lengths(n, idx, idx + d, similarity)
        a = idx[near]
        a = a[roots[a] != roots[a + d]]
        yield a, a + d
        d += 1
        idx = idx[near & (left[idx] >= d)]  # lengths rise within a run


def _distinct_pairs(fps: np.ndarray, found) -> tuple[np.ndarray, np.ndarray]:
    """Names (a < b) of the positions found, each pair once."""
    held, waiting, size = np.empty((0, 2), np.uint64), [], 0
    for a, b in found:
        waiting.append(np.sort(np.stack([fps[a], fps[b]], axis=1), axis=1))
        size += len(a)
        if size > PER_TASK:
            held, waiting, size = np.unique(np.concatenate([held, *waiting]), axis=0), [], 0
    held = np.unique(np.concatenate([held, *waiting]), axis=0)
    return np.ascontiguousarray(held[:, 0]).view(np.int64), np.ascontiguousarray(held[:, 1]).view(np.int64)


def candidates(sets: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b, run): pairs of names of different roots that share a prefix member; for keys of many members, their packed members to go through again.

    sets: one row a name: (fp, n, prefix, root).
    """
    entries = sets.select(F.coalesce(F.sum(F.length("prefix")), F.lit(0)).alias("n")).first()["n"] // 8
    parts = np.uint64(entries // PER_TASK + 1)

    def deal(batches):
        for b in batches:
            keys = [np.frombuffer(x, np.uint64) for x in b.column("prefix").to_pylist()]
            size = [len(k) for k in keys]
            e = np.empty(sum(size), _ENTRY)
            e["key"] = np.concatenate([np.empty(0, np.uint64), *keys])
            for c in ("fp", "root"):
                e[c] = np.repeat(np.asarray(b.column(c)).view(np.uint64), size)
            e["n"] = np.repeat(np.asarray(b.column("n")), size)
            part = (e["key"] >> np.uint64(32)) % parts
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=parts))
            rows = [e[order[i:j]].tobytes() for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(part[order[cuts]].astype(np.int64)), "e": pa.array(rows, pa.binary())})

    def join(table: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(table.column("e").to_pylist()), _ENTRY)
        order = np.argsort(e["key"], kind="stable")
        same = np.diff(e["key"][order]) == 0
        e = e[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]  # most members are one set's alone
        e = e[np.lexsort((e["fp"], e["n"], e["key"]))]
        cuts = np.flatnonzero(np.diff(e["key"], prepend=~e["key"][:1]))
        length = np.diff(np.append(cuts, len(e)))
        left = np.repeat(cuts + length, length) - np.arange(len(e)) - 1
        large = np.repeat(length > DIRECT, length)
        n, root = e["n"].astype(np.int64), e["root"]
        open_runs = [(i, m) for i, m in zip(cuts[length > DIRECT].tolist(), length[length > DIRECT].tolist(), strict=True) if (root[i : i + m] != root[i]).any()]

        a, b = _distinct_pairs(e["fp"], _pairs(n, np.where(large, 0, left), similarity, root))
        runs = [e[k : min(k + RUN, i + m)].tobytes() for i, m in open_runs for k in range(i, i + m, RUN)]
        return pa.table({"a": pa.array([*a, *[None] * len(runs)], pa.int64()), "b": pa.array([*b, *[None] * len(runs)], pa.int64()), "run": pa.array([*[None] * len(a), *runs], pa.binary())})

    return sets.where("n > 0").select("fp", "root", "n", "prefix").mapInArrow(deal, "part long, e binary").groupBy("part").applyInArrow(join, "a long, b long, run binary")


def _folded(bits: list[bytes], size: int) -> np.ndarray:
    """Bitmaps as rows of size bytes; the XOR of the halves of a bitmap is that of half the size."""
    rows = [np.frombuffer(x, np.uint8) for x in bits]
    return np.stack([np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in rows]).view(np.uint64)


def _compare(table: pa.Table, similarity: Fraction, nearest: bool) -> pa.Table:
    """Pairs (a, b) of one key and pair of blocks whose bitmaps don't rule them out; nearest: one for each set."""
    fp, n, root = (np.asarray(table.column(c)) for c in ("fp", "n", "root"))
    own, bits = np.asarray(table.column("own")), table.column("bits").to_pylist()
    other = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    size = np.array([len(x) for x in bits])
    out_a, out_b = [], []
    for s in np.unique(size):
        mine = np.flatnonzero(size == s)
        # lengths of a pair differ by a quarter at most, so their bitmaps by one step of size
        for t, yours in ((t, np.flatnonzero(size == t)) for t in (s // 2, s, 2 * s)):
            if not len(yours):
                continue
            x, y = _folded([bits[i] for i in mine], min(s, t)), _folded([bits[i] for i in yours], min(s, t))
            for lo in range(0, len(mine), 128):
                at = mine[lo : lo + 128]
                apart = np.zeros((len(at), len(yours)), np.int64)
                for k in range(x.shape[1]):
                    apart += np.bitwise_count(x[lo : lo + 128, k, None] ^ y[None, :, k])
                both = n[at][:, None] + n[yours]
                may = (root[at][:, None] != root[yours]) & ((both - apart) * similarity.denominator >= (both + apart) * similarity.numerator)
                may &= _near_lengths(n, at[:, None], yours[None, :], similarity)
                if other:
                    may &= own[at][:, None] != own[yours]
                if nearest:
                    best = np.where(may, apart, np.iinfo(np.int64).max).argmin(axis=1)
                    some = may[np.arange(len(at)), best]
                    found = at[some], yours[best[some]]
                else:
                    may &= fp[at][:, None] < fp[yours]
                    i, j = np.nonzero(may)
                    found = at[i], yours[j]
                out_a.append(np.minimum(fp[found[0]], fp[found[1]]))
                out_b.append(np.maximum(fp[found[0]], fp[found[1]]))
    empty = np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])], axis=1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def open_pairs(runs: DataFrame, roots: DataFrame, least: DataFrame, similarity: Fraction, nearest: bool) -> DataFrame:
    """(a, b) of the keys of many members (column run) between the components (node, root) found so far.

    A key's members are cut into blocks, and a task compares two blocks, so no task grows with a key.
    """

    def unpack(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                e = np.frombuffer(x, _ENTRY)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[c]).view(np.int64)) for c in ("key", "fp")], ["key", "fp"])

    members = runs.select("run").mapInArrow(unpack, "key long, fp long").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    per = members.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    placed = members.join(per, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    each = F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)
    dealt = placed.join(least.select("fp", "n", "bits"), "fp").select("key", "fp", "n", "root", "bits", "own", F.explode(each).alias("o"))
    dealt = dealt.select("key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "fp", "n", "root", "bits")
    return dealt.groupBy("key", "i", "j").applyInArrow(lambda t: _compare(t, similarity, nearest), "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, least: DataFrame, similarity: Fraction, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity; least: (fp, least, n, bits) leads to a text of each."""

    def rule_out(batches):
        for b in batches:
            stay = [may_reach(*x, similarity) for x in zip(*(b.column(c).to_pylist() for c in ("n", "x", "m", "y")), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    first, second = least.select(F.col("fp").alias("a"), "n", F.col("bits").alias("x")), least.select(F.col("fp").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    pairs = stored(pairs.join(first, "a").join(second, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(rule_out, "a long, b long"), "near")
    wanted = stored(pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct(), "wanted")
    ids = least.join(wanted, "fp", "left_semi").select(F.col("least").alias("_wanted")).distinct()
    texts = docs.join(ids, docs[id_col].cast("long").eqNullSafe(F.col("_wanted")), "left_semi")

    def run(batches):
        for b in sliced(batches):
            found = [shingle_set(d, words) for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_name(x) for x in found], np.uint64).view(np.int64)), pa.array([x.tobytes() for x in found], pa.binary())], ["fp", "members"])

    def check(batches):
        for b in batches:
            stay = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                stay.append(both * similarity.denominator >= (len(x) + len(y) - both) * similarity.numerator)
            yield b.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    sets = stored(id_and_bytes(texts, id_col, text_col).mapInArrow(run, "fp long, members binary").join(wanted, "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def completed(links: DataFrame, docs: DataFrame, least: DataFrame, similarity: Fraction, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, root): the components of all pairs of that similarity, from links and what the join on prefixes adds.

    least: (fp, least, n, prefix, bits), a row a set.
    """
    roots = components(links)
    sets = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "prefix", F.coalesce("root", "fp").alias("root"))
    found = stored(candidates(sets, similarity), "candidates")
    pairs = stored(found.where("run IS NULL").select("a", "b").distinct(), "pairs")
    roots = regrouped(roots, verified(pairs, docs, least, similarity, words, id_col, text_col))
    runs = found.where("run IS NOT NULL")
    if not runs.isEmpty():
        for nearest in (True, False):
            more = stored(open_pairs(runs, roots, least, similarity, nearest).join(pairs, ["a", "b"], "left_anti"), "more")
            roots = regrouped(roots, verified(more, docs, least, similarity, words, id_col, text_col))
            pairs = pairs.unionByName(more)
    return roots
