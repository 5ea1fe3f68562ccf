"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights. Candidates are dealt to splits and queries to groups,
both of bounded size; a task holds one split and one group. It lays a block of candidates out as
postings (term -> rows and weights); a query row scatters its weight times the postings of each
of its terms into a dense array of scores, a partition selection keeps k, and a window merges
what the splits found.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a candidate block: its array of scores stays in a core's cache.
BLOCK = 4096
#: Candidates and queries that a task holds.
SPLIT, GROUP = 16_384, 32_768
#: Whole numbers of this size and beyond have no fraction as doubles.
WHOLE = float(1 << 53)


def quantise(vec: Column, scale: float = 256.0) -> Column:
    """Each component x as floor(scale * x), x and result as double; null for vectors with a null or non-finite component.

    Doubles hold these whole numbers exactly, also where a long would not.
    """
    x = vec.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(F.abs(v) >= WHOLE, v).otherwise(F.floor(F.greatest(F.lit(-WHOLE), F.least(F.lit(WHOLE), v))).cast("double"))
    return F.when(finite, F.transform(x, lambda v: whole(v * scale)))


def _rows(table: pa.Table, ids: str, vecs: str) -> tuple[np.ndarray, list[np.ndarray]]:
    w = table.column(vecs).combine_chunks()
    cuts = np.cumsum(np.asarray(w.value_lengths()))[:-1] if len(w) else []
    return np.asarray(table.column(ids)), np.split(np.asarray(w.flatten(), np.float64), cuts) if len(w) else []


class _Postings:
    """Candidates by term: rows (None: all of them) and their weights."""

    def __init__(self, ids: np.ndarray, rows: list[np.ndarray]):
        self.ids, self.n = ids, len(rows)
        lens = np.array([len(r) for r in rows], np.int64)
        w = np.concatenate([np.zeros(0), *rows]).astype(np.int64)
        row, term = np.repeat(np.arange(len(rows)), lens), np.arange(len(w)) - np.repeat(np.cumsum(lens) - lens, lens)
        order = np.lexsort((row, term))
        row, term, w = row[order], term[order], w[order]
        cuts = np.flatnonzero(np.diff(term, prepend=-1))
        self.lists = []
        for i, j in zip(cuts, np.append(cuts[1:], len(term)), strict=False):  # no cut: no row has a term
            used = np.flatnonzero(w[i:j]) + i
            full = j - i == self.n and 2 * len(used) > self.n
            self.lists.append((None, w[i:j]) if full else (row[used], w[used]))

    def scores(self, query: np.ndarray) -> np.ndarray:
        total, step = np.zeros(self.n, np.int64), np.empty(self.n, np.int64)
        for weight, (rows, post) in zip(query.astype(np.int64).tolist(), self.lists, strict=False):
            if weight and rows is None:
                np.multiply(post, weight, out=step)
                total += step
            elif weight:
                total[rows] += post * weight  # a row has a term once, so positions are distinct
        return total


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of other rows, ties to the smaller id; own: the query's id."""
    other = ids != own
    n = int(other.sum())
    if n > k:
        masked = np.where(other, scores, np.iinfo(np.int64).min)
        other &= scores >= np.partition(masked, len(masked) - k)[len(masked) - k]  # all ties of the last place
    at = np.flatnonzero(other)
    at = at[np.lexsort((ids[at], -scores[at]))][:k]
    return ids[at], scores[at]


def _exact(query: np.ndarray, rows: list[np.ndarray]) -> list[int]:
    """Scores in whole numbers of any size."""
    q = [int(x) for x in query]
    return [sum(a * int(b) for a, b in zip(q, r.tolist(), strict=False)) for r in rows]


def _search(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        ids, rows = _rows(candidates, "vec_id", "w")
        q_ids, q_rows = _rows(queries, "query_id", "w")
        out = {"query_id": [], "vec_id": [], "score": []}

        def add(query: int, found, scores) -> None:
            out["query_id"] += [query] * len(found)
            out["vec_id"] += found
            out["score"] += scores

        # weights within this size can't add up beyond a long; rows with larger ones are summed in numbers of any size
        terms = max([1, *map(len, rows), *map(len, q_rows)])
        largest = lambda r: float(np.abs(r).max(initial=0))
        safe = int(np.sqrt((1 << 62) / terms))
        wide = np.array([largest(r) > safe for r in rows], bool)
        small, large = np.flatnonzero(~wide), np.flatnonzero(wide).tolist()
        blocks = [_Postings(ids[b], [rows[i] for i in b]) for b in (small[i : i + BLOCK] for i in range(0, len(small), BLOCK))]
        for own, q in zip(q_ids.tolist(), q_rows, strict=True):
            slow = list(range(len(rows))) if largest(q) > safe else large
            if slow is large:
                found = [_best(b.ids, b.scores(q), own, k) for b in blocks]
                if found:
                    best, scores = _best(*(np.concatenate(x) for x in zip(*found, strict=True)), own, k)
                    add(own, best.tolist(), scores.tolist())
            if slow:
                pairs = zip(_exact(q, [rows[i] for i in slow]), ids[slow].tolist(), strict=True)
                found = heapq.nsmallest(k, ((-s, i) for s, i in pairs if i != own))
                if found and -found[0][0] >= 1 << 63:
                    raise OverflowError(f"the score of {own} and {found[0][1]} is beyond a long")
                # below a long: null, which the merge puts last
                add(own, [i for _, i in found], [-s if -s >= -(1 << 63) else None for s, _ in found])
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row that is_query picks.

    Ties go to the smaller id. Vectors null or with a null or non-finite component take no part,
    nor do rows with a null id. Rows with the query's own id are not its candidates; otherwise a
    repeated row is a candidate as often as it occurs, and a repeated query counts once. Queries
    of one id with different vectors share one ranking, as the id alone names them. Lengths may
    differ: a term that a row lacks weighs 0. No component is clamped; a result whose score is
    beyond a long is an error. Empty table: empty result. Other columns are left out, so names
    can't clash. Candidates are dealt to splits of even size whatever their ids, queries are
    copied to each split and candidates to each group of queries, so no task grows with the data.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vec_col), scale).alias("w"), is_query.alias("q")).where("vec_id is not null and w is not null")
    spark = vectors.sparkSession
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    splits, groups = max(-(-n // SPLIT), min(n, spark.sparkContext.defaultParallelism)), -(-n_queries // GROUP)
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("vec_id", "w", F.pmod(F.monotonically_increasing_id(), F.lit(splits)).cast("int").alias("s")).select("s", each(groups).alias("g"), "vec_id", "w")
    queries = rows.where("q").select(F.col("vec_id").alias("query_id"), "w").distinct()
    queries = queries.select(F.pmod(F.xxhash64("query_id", "w"), F.lit(groups)).cast("int").alias("g"), "query_id", "w").select(each(splits).alias("s"), "g", "query_id", "w")
    best = candidates.groupBy("s", "g").cogroup(queries.groupBy("s", "g")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "vec_id")
    ranked = best.select("query_id", F.row_number().over(w).cast(T.IntegerType()).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    return ranked.withColumn("score", F.coalesce("score", F.raise_error(F.lit("a score is beyond a long")).cast("long")))
