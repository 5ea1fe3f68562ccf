"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most 4 bits are linked. Cut into 3 segments, any such
pair has a segment in which it differs in at most one bit; so with every segment indexed under
each of its one-wildcard variants (64 in all), some key is equal. Distinct fingerprints alone
are indexed; members of a key are verified on all 64 bits, and a key yields links that span its
linked members, never all pairs. A key with many members is split again by the same rule over
the bits that it leaves open.

With a similarity, links are verified on the shingle sets themselves. Few bits reach only part of
the pairs of a Jaccard similarity of 0.8 (about 10 of 64 bits differ on average), and segments
short enough for all of them would put unlike texts under one key; so pairs that the signatures
don't connect are found by the exact join of ``shingle_sets``.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import shingle_sets
from tidewright.llm.common import components, id_and_bytes, sliced, stored

BITS = 64
#: Members of a key that are compared with each other directly; more are split by further variants.
DIRECT = 1024
#: Fingerprints a task sorts at once.
PER_TASK = 200_000
SEED = shingle_sets.SEED


def fingerprint(data: bytes | None, words: int = 4) -> int:
    """SimHash of the word shingles of a text: A-Z lowered, words parted by ASCII white space."""
    tokens = (data or b"").lower().split()
    if not tokens:
        return 0
    text = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = (np.concatenate([[0], ends[:-1] + 1])).tolist()
    ends = ends[words - 1 :].tolist() or [len(text)]
    digest = xxhash.xxh64_intdigest
    parts = (slice(lo, lo + (1 << 16)) for lo in range(0, len(ends), 1 << 16))
    return shingle_sets.majority(np.array([digest(text[s:e], SEED) for s, e in zip(starts[p], ends[p], strict=False)], "<u8") for p in parts)


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the 64 bits as a signed long; null or empty text: 0."""

    def run(batches):
        for b in sliced(batches):
            fps = np.array([fingerprint(d, words) for d in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _segments(bits: list[int], n: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(bits, n)]


def _mask(bits) -> np.uint64:
    return np.uint64(sum(1 << int(b) for b in bits))


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _link(fps: np.ndarray, within: np.ndarray, members: np.ndarray, open_bits: list[int], limit: int, parent: np.ndarray, out: list) -> None:
    """Links members (positions in fps, of equal key) that differ in at most limit bits.

    within: the key of each member, sorted; runs of equal keys are compared. Runs over DIRECT
    are dealt again by one-wildcard variants of segments of the open bits.
    """
    cuts = np.flatnonzero(np.diff(within)) + 1
    length = np.diff(np.concatenate([[0], cuts, [len(within)]]))
    left = np.repeat(np.cumsum(length), length) - np.arange(len(within)) - 1  # members after this one in its run
    large = np.repeat(length, length) > DIRECT
    can_split = len(open_bits) > 3 * (limit // 2 + 1)
    idx = np.flatnonzero((left > 0) & ~(large & can_split))
    d = 1
    while len(idx):
        a, b = members[idx], members[idx + d]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= limit
        for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
            x, y = _find(parent, i), _find(parent, j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((i, j))
        d += 1
        idx = idx[left[idx] >= d]
    if can_split and large.any():
        for run in np.split(np.flatnonzero(large), np.flatnonzero(np.diff(within[large])) + 1):
            for segment in _segments(open_bits, limit // 2 + 1):
                for wild in segment:
                    key = fps[members[run]] & _mask(b for b in segment if b != wild)
                    order = np.argsort(key, kind="stable")
                    rest = [b for b in open_bits if b not in segment]
                    _link(fps, key[order], members[run][order], rest, limit, parent, out)


def links(distinct: DataFrame, limit: int = 4) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp): enough links that components are those of all pairs."""
    segments = _segments(list(range(BITS)), limit // 2 + 1)
    variants = [(k, wild) for k in range(len(segments)) for wild in segments[k]]
    masks = np.array([_mask(b for b in segments[k] if b != wild) for k, wild in variants], np.uint64)
    parts = -(-distinct.count() // PER_TASK) or 1
    step = np.uint64(parts)

    def deal(batches):
        for b in batches:
            fps = np.asarray(b.column(0)).view(np.uint64)
            for v, mask in enumerate(masks):
                part = (((fps & mask) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % step
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order], prepend=np.uint64(parts)))
                rows = [fps[order[i:j]].tobytes() for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True)]
                yield pa.RecordBatch.from_pydict({"v": pa.array([v] * len(rows), pa.int32()), "part": pa.array(part[order[cuts]].astype(np.int64)), "fps": pa.array(rows, pa.binary())})

    def join(table: pa.Table) -> pa.Table:
        v = table.column("v")[0].as_py()
        fps = np.unique(np.frombuffer(b"".join(table.column("fps").to_pylist()), np.uint64))
        key = fps & masks[v]
        order = np.argsort(key, kind="stable")
        parent, out = np.arange(len(fps)), []
        used = set(segments[variants[v][0]])
        _link(fps, key[order], order, [b for b in range(BITS) if b not in used], limit, parent, out)
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": fps[found[:, 0]].view(np.int64), "b": fps[found[:, 1]].view(np.int64)})

    return distinct.select("fp").mapInArrow(deal, "v int, part long, fps binary").groupBy("v", "part").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, limit: int = 4, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the smallest doc_id reachable over links.

    One row for each row of docs. similarity None: links are fingerprints that differ in at most
    limit bits, and fp is the fingerprint. With a similarity: links are texts whose sets of
    shingles have that Jaccard similarity or more, all of them, and fp names the set. Fewer words
    than a shingle: the whole sequence is the only shingle; no word (null, empty or blank text):
    fingerprint 0, linked like any other, and with a similarity alike. Very long texts are hashed
    whole. Null ids take part but don't name a component unless all of its ids are null. Repeated
    rows share a component. Empty table: empty result. Other columns are left out, so names can't
    clash. Shingles and sets of equal 64-bit hash count as equal.
    """
    if similarity is not None:
        return _similar(docs, words, limit, Fraction(str(similarity)), id_col, text_col)
    prints = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return named(prints, distinct, components(stored(links(distinct, limit), "links")))


def _similar(docs: DataFrame, words: int, limit: int, similarity: Fraction, id_col: str, text_col: str) -> DataFrame:
    sets = stored(shingle_sets.prefixes(docs, similarity, words, id_col, text_col), "prefixes")
    least = stored(sets.groupBy("fp").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "prefix", "bits", "print")]), "least")
    # a fingerprint stands for one of its sets; others of the same fingerprint are paired with that one
    stars = stored(least.where("n > 0").groupBy("print").agg(F.min("fp").alias("star")), "stars")
    near = links(stars.select(F.col("print").alias("fp")), limit)
    ends = [stars.select(F.col("print").alias(c), F.col("star").alias(f"star_{c}")) for c in "ab"]
    between = near.join(ends[0], "a").join(ends[1], "b").select(F.least("star_a", "star_b").alias("a"), F.greatest("star_a", "star_b").alias("b"))
    within = least.where("n > 0").select("fp", "print").join(stars, "print").where("fp <> star").select(F.least("fp", "star").alias("a"), F.greatest("fp", "star").alias("b"))
    found = stored(shingle_sets.verified(stored(between.unionByName(within).distinct(), "pairs"), docs, least, similarity, words, id_col, text_col), "links")
    return named(sets.select("doc_id", "fp"), least.select("fp", "least"), shingle_sets.completed(found, docs, least, similarity, words, id_col, text_col))


def named(prints: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) from prints (doc_id, fp), distinct (fp, least doc_id) and the components (node, root) of fps."""
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = stored(rooted.select("fp", "root").join(names, "root").select("fp", "component_id"), "named")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stand for their group: that of the smallest doc_id; all columns kept.

    Of repeated rows of that id, and of a group whose ids are all null, one row stays.
    """
    return one_of_each(docs, near_duplicates(docs, **options))


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """keep_one, from what near_duplicates returns; columns travel in a struct, so their names can't clash."""
    stay = found.where("doc_id <=> component_id").select("doc_id").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    # repeated ids alone go through a choice; ids that occur once pass untouched
    again = stored(kept.groupBy("id").count().where("count > 1").select(F.col("id").alias("again")), "again")
    if again.isEmpty():
        return kept.select("row.*")
    same = F.col("id").eqNullSafe(F.col("again"))
    once = kept.join(again, same, "left_anti").select("row")
    return once.unionByName(kept.join(again, same, "left_semi").groupBy("id").agg(F.first("row").alias("row")).select("row")).select("row.*")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query, from what near_duplicates returns."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
