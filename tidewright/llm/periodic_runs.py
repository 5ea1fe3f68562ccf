"""Periodic runs of words, caught online by dyadic squares.

Words are appended to a stream. Whenever a block of 2^j words that is aligned to 2^j is complete,
a catcher of level j holds its name and waits for the block to come again at a distance of
2^(j+1)-1 to 2^(j+2)-2: the first half of every square of such a period contains an aligned block
of 2^j words. At any word two catchers of a level are live. A block that came again is extended
to both sides to the stretch in which words that far apart are equal; stretches that reach the
end of the stream are advanced with every append. A stretch at least as long as its distance is
a run of squares. What is found doesn't depend on how the words are dealt to appends, and names
of a level are kept only as far back as its catchers look.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import id_and_bytes, sliced

#: Words of an append, and of a stream of several texts.
APPEND = 1 << 16
#: Bytes of texts that are handled together; a longer text is handled by itself.
RUN_BYTES = 8 << 20
#: Blocks from this size on are extended by slices, smaller ones word by word for all at once.
SLICED = 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


class SquareCatcher:
    """An online stream of word numbers; ``append`` returns the squares that the appended words complete."""

    def __init__(self, longest: int, least_words: int = 2, least_exponent: int = 2):
        """longest: words of the longest text of the stream; it bounds the periods to look for."""
        self.words, self.n = np.empty(max(longest, 1), np.int64), 0
        self.least_words, self.least_exponent = least_words, least_exponent
        self.levels = 0
        while self.least_exponent * (2 * (1 << self.levels) - 1) <= longest:
            self.levels += 1
        #: of each level: names of the blocks that start at at.. ; and the first start without a name
        self.names = [np.empty(0, np.uint64) for _ in range(self.levels)]
        self.at = [0] * self.levels
        #: stretches that reach the end of the stream: first word that equals the one a distance before it, by distance
        self.active: dict[int, int] = {}
        self.closed: list[np.ndarray] = []

    def append(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(period, first end, last end): squares of a period that end at these appended words, by their last words."""
        a, b = self.n, self.n + len(words)
        if b > len(self.words):
            self.words = np.concatenate([self.words[:a], np.empty(max(b - a, a), np.int64)])
        self.words[a:b], self.n = words, b
        ended = []  # (start, end, distance) of stretches that ended within these words
        for q in sorted(self.active):
            same = self.words[a:b] == self.words[a - q : b - q]
            if not same.all():
                ended.append((self.active.pop(q), a + int(same.argmin()), q))
        found = [np.array(ended, np.int64).reshape(-1, 3)]
        for j in range(self.levels):
            found.append(self._catch(j, found, b))
        done = np.concatenate(found)
        live = np.array([(x, b, q) for q, x in self.active.items()], np.int64).reshape(-1, 3)
        self.closed.append(done[self._enough(done)])
        new = np.concatenate([done, live])
        new = new[new[:, 1] - new[:, 0] >= new[:, 2]]
        first = np.maximum(new[:, 0] + new[:, 2] - 1, a)
        return [(int(q), int(f), int(e) - 1) for (_, e, q), f in zip(new, first, strict=True) if f < e]

    def _enough(self, s: np.ndarray) -> np.ndarray:
        size = s[:, 1] - s[:, 0] + s[:, 2]
        return (size >= self.least_words) & (size >= self.least_exponent * s[:, 2])

    def _grow(self, j: int, b: int) -> tuple[int, int]:
        """Names the blocks of a level that are complete now; returns the range of their starts."""
        m, held = 1 << j, self.at[j] + len(self.names[j])
        stop = max(held, b - m + 1)
        if j == 0:
            new = _mixed(self.words[held:stop].astype(np.uint64) * _B + _A)
        else:
            low, at = self.names[j - 1], self.at[j - 1]
            new = _mixed(low[held - at : stop - at] * _B + low[held - at + m // 2 : stop - at + m // 2])
        self.names[j] = np.concatenate([self.names[j], new])
        return held, stop

    def _forget(self, j: int) -> None:
        """Names that neither the catchers of the level nor the next level's names need any more."""
        m = 1 << j
        first = self.at[j] + len(self.names[j]) - 8 * m
        if first - self.at[j] > max(APPEND, 8 * m):
            self.names[j], self.at[j] = self.names[j][first - self.at[j] :].copy(), first

    def _catch(self, j: int, before: list[np.ndarray], b: int) -> np.ndarray:
        """Advances the catchers of a level; returns the stretches that ended, (start, end, distance)."""
        m, (e0, e1) = 1 << j, self._grow(j, b)
        names, at = self.names[j], self.at[j]
        e = np.arange(e0, e1)
        block = (e - (2 * m - 1)) // m * m
        hits_e, hits_q = [], []
        for live in (block, block - m):
            ok = live >= at
            hit = np.flatnonzero(ok & (names[e - at] == names[np.where(ok, live - at, 0)]))
            hits_e.append(e[hit])
            hits_q.append(e[hit] - live[hit])
        if j:
            self._forget(j - 1)
        if j == self.levels - 1:
            self._forget(j)
        e, q = np.concatenate(hits_e), np.concatenate(hits_q)
        if not len(e):
            return np.empty((0, 3), np.int64)
        order = np.argsort(e, kind="stable")
        e, q = e[order], q[order]
        fresh = np.ones(len(e), bool)
        # what a run of a period that divides the distance covers is that run itself
        known = [s[(s[:, 1] - s[:, 0] >= 2 * m - 1) & (s[:, 2] < 2 * m)] for s in before]
        known.append(np.array([(x, b, p) for p, x in self.active.items() if b - x >= 2 * m - 1 and p < 2 * m], np.int64).reshape(-1, 3))
        for x, y, p in np.concatenate(known).tolist():
            i, k = np.searchsorted(e, x), np.searchsorted(e, y - m, side="right")
            qs = q[i:k]
            fresh[i:k] &= (qs % p != 0) | (e[i:k] - qs < x - p) | (y - x < qs)
        # and what a known stretch of the same distance holds was advanced word by word
        for x, y, p in [*before[0].tolist(), *((x, b, p) for p, x in self.active.items())]:
            if 2 * m - 1 <= p <= 4 * m - 2:
                fresh &= (q != p) | (e < x) | (e >= y)
        e, q = e[fresh], q[fresh]
        order = np.lexsort((e, q))
        e, q = e[order], q[order]
        same = self._same(e, q, m)
        e, q = e[same], q[same]
        if not len(e):
            return np.empty((0, 3), np.int64)
        # hits of a distance that adjoin are one stretch
        first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (e[1:] > e[:-1] + m)]))
        start, end, dist = e[first], e[np.append(first[1:], len(e)) - 1] + m, q[first]
        start, end = self._extended(start, end, dist, b, m)
        out = np.unique(np.stack([start, end, dist], axis=1), axis=0)
        open_ = out[:, 1] == b
        for x, _, p in out[open_].tolist():
            self.active[p] = min(x, self.active.get(p, x))
        return out[~open_]

    def _same(self, e: np.ndarray, q: np.ndarray, m: int) -> np.ndarray:
        """Whether the blocks of the hits are equal word by word: equal names prove nothing."""
        w = self.words
        if m >= SLICED:
            return np.array([np.array_equal(w[x : x + m], w[x - p : x - p + m]) for x, p in zip(e.tolist(), q.tolist(), strict=True)], bool)
        at = e[:, None] + np.arange(m)
        return (w[at] == w[at - q[:, None]]).all(axis=1)

    def _extended(self, start: np.ndarray, end: np.ndarray, dist: np.ndarray, b: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Stretches as far as words a distance apart are equal: less than a block to either side."""
        w = self.words
        if m >= SLICED:
            for i, (x, y, q) in enumerate(zip(start.tolist(), end.tolist(), dist.tolist(), strict=True)):
                before = (w[max(x - m, q) : x] == w[max(x - m, q) - q : x - q])[::-1]
                start[i] = x - (len(before) if before.all() else int(before.argmin()))
                after = w[y : min(y + m, b)] == w[y - q : min(y + m, b) - q]
                end[i] = y + (len(after) if after.all() else int(after.argmin()))
            return start, end
        live = np.flatnonzero(start > dist)
        while len(live):
            x = start[live] - 1
            live = live[w[x] == w[x - dist[live]]]
            start[live] -= 1
            live = live[start[live] > dist[live]]
        live = np.flatnonzero(end < b)
        while len(live):
            live = live[w[end[live]] == w[end[live] - dist[live]]]
            end[live] += 1
            live = live[end[live] < b]
        return start, end

    def runs(self) -> np.ndarray:
        """(start, length, period) of all runs so far, by start and period: squares of a period merged, smallest periods only."""
        live = np.array([(x, self.n, q) for q, x in self.active.items()], np.int64).reshape(-1, 3)
        s = np.concatenate([*self.closed, live])
        s = s[self._enough(s)]
        s = np.unique(np.stack([s[:, 0] - s[:, 2], s[:, 1] - s[:, 0] + s[:, 2], s[:, 2]], axis=1), axis=0)
        # equal stretches of several distances: the least divides the others
        return s[np.concatenate([[True], (s[1:, :2] != s[:-1, :2]).any(axis=1)])] if len(s) else s


def runs_of(texts: list[np.ndarray], least_words: int = 6, least_exponent: int = 4) -> list[np.ndarray]:
    """(start, length, period) of the runs of each text, given as word numbers of 0 or more.

    Short texts share a stream; a word of its own ends each of them, so no square crosses it.
    """
    out: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(texts)
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    k = 0
    while k < len(order):
        group, size = [], 0
        # texts of like length: the longest decides how many levels the stream has
        while k < len(order) and (not group or size + len(texts[order[k]]) < APPEND):
            group.append(order[k])
            size += len(texts[order[k]]) + 1
            k += 1
        stream = np.concatenate([x for i, g in enumerate(group) for x in (texts[g], np.array([-1 - i], np.int64))])
        catcher = SquareCatcher(max(len(texts[g]) for g in group), least_words, least_exponent)
        for a in range(0, len(stream), APPEND):
            catcher.append(stream[a : a + APPEND])
        found = catcher.runs()
        starts = np.concatenate([[0], np.cumsum([len(texts[g]) + 1 for g in group])])
        cut = np.searchsorted(found[:, 0], starts)
        for i, g in enumerate(group):
            if cut[i] < cut[i + 1]:
                out[g] = found[cut[i] : cut[i + 1]] - np.array([starts[i], 0, 0])
    return out


def _words(data: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts and how many each has; ASCII white space ends a word."""
    parts = pc.ascii_split_whitespace(data.cast(pa.large_binary()).view(pa.large_string()))
    flat, lens = parts.flatten(), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    held = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(held.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(lens)])
    return flat.filter(held), np.diff(kept[ends])


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


def find_runs(docs: DataFrame, least_words: int = 6, least_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed), one row for each row of docs.

    Words are maximal stretches without ASCII white space (\\x20, \\x09 to \\x0D), numbered from 0.
    A run is a stretch of smallest period q, of at least least_words words and least_exponent
    times q (2 at least), that no neighbouring word extends; runs come by start, then period. collapsed: the
    words joined by one blank, without what follows a run's first q words in any run. Null and
    empty texts have no word and no run. Texts are judged one by one, so null and repeated ids
    and repeated rows need no rule; very long texts are handled by themselves, in memory of some
    40 bytes a word. Empty table: empty result. Other columns are left out, so names can't clash.
    """

    def judged(part: pa.RecordBatch):
        flat, lens = _words(part.column(1))
        ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.empty(0, np.int64)
        ends = np.cumsum(lens)
        found = runs_of([ids[e - n : e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)], least_words, least_exponent)
        stays = np.concatenate([_kept(n, r) if len(r) else np.ones(n, bool) for n, r in zip(lens.tolist(), found, strict=True)])
        left = flat.filter(pa.array(stays))
        at = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], ends])]
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), left), pa.scalar(" ", pa.large_string()))
        every = np.concatenate(found)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
        runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], ["start", "length", "period"]))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(lens, pa.int64()), runs, joined.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        for b in sliced(batches, 4000):
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + RUN_BYTES, side="right")))
                yield judged(b.slice(i, j - i))
                i = j

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(df: DataFrame) -> DataFrame:
    """The columns of the registered query, from what find_runs returns."""
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(order)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return df.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed").select(
        "doc_id", "n_runs", F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"),
        F.expr("-b.l * 1000 div b.p").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
