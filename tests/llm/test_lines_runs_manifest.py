"""Line dedup, periodic runs and the Merkle manifest against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import line_dedup, merkle, periodic_runs, queries

BLANK = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
lower = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def lines_by_hand(rows, least_docs=5, least_chars=40):
    key = lambda x: lower(x.strip(BLANK))
    holds = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                holds[key(x)].add(float("-inf") if i is None else i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(holds[key(x)]) < least_docs or max(holds[key(x)]) == i]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    long = ["é" * 39, "é" * 40, "Shared LINE of a licence that everybody copies around", "shared line of a licence that everybody copies AROUND\r", "\x0b\tshared line of a licence that everybody copies around \x0c", "x" * 40, "İ" + "x" * 39, " " + "y" * 39, "", " "]
    rows = [(i, "\n".join(rng.choice([*long, f"own {rng.random()} line that is long enough to be counted here"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(None, None), (None, long[2]), (7, rows[7][1]), (7, rows[7][1]), (100, ""), (101, "\n\n"), (102, "\n".join([long[5]] * 5000 + [str(k) for k in range(5000)])), (-5, long[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("t", "pos", "line", "gone", "h1", "n")}).repartition(5)
    got = line_dedup.drop_common_lines(df).collect()
    assert Counter(map(tuple, (r[:1] + (r["n_lines"], r["n_dropped"], r["kept"]) for r in got))) == lines_by_hand(rows)
    assert sum(r["n_dropped"] for r in got) > 100
    assert line_dedup.drop_common_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [4, 5])
def test_a_document_counts_once_however_often_it_holds_a_line(spark, copies):
    line = "z" * 50
    rows = [(i, f"{line}\n{line}\nx") for i in range(copies)] + [(0, f"{line}\n{line}\nx")]
    assert Counter(tuple(r) for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", "kept").collect()) == lines_by_hand(rows)


def runs_by_hand(w, least_words=6, least=4):
    found = {}
    for q in range(1, len(w) // least + 1):
        x = 0
        while x < len(w) - q:
            y = x
            while y < len(w) - q and w[y] == w[y + q]:
                y += 1
            if y - x + q >= max(least_words, least * q):
                found.setdefault((x, y - x + q), q)
            x = max(y, x + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def streams(seed, n):
    rng = random.Random(seed)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 130:
        fib.append(fib[-1] + fib[-2])
    for k in range(n):
        size, kind = rng.randint(0, 120), k % 5
        if kind < 2:
            yield [rng.randint(0, 1 + 2 * kind) for _ in range(size)]
        elif kind == 2:
            yield fib[-1][:size]
        elif kind == 3:
            yield [x for _ in range(rng.randint(1, 9)) for x in [rng.randint(0, 2) for _ in range(rng.randint(1, 9))] * rng.randint(1, 8)]
        else:
            yield [int(rng.random() < 0.02) for _ in range(size)]


@pytest.mark.parametrize("sliced,least_words,least", [(64, 6, 4), (1, 2, 2), (4, 3, 3)])
def test_catcher_equals_brute_force_however_words_are_dealt(monkeypatch, sliced, least_words, least):
    monkeypatch.setattr(periodic_runs, "SLICED", sliced)
    rng = random.Random(sliced)
    for w in streams(sliced, 300):
        deal = rng.choice([1, 3, 40, 1000])
        c, a, seen = periodic_runs.SquareCatcher(len(w), least_words, least), 0, set()
        while a < len(w):
            step = rng.randint(1, deal)
            for q, first, last in c.append(np.array(w[a : a + step], np.int64)):
                assert a <= first <= last < a + step
                for x in range(first, last + 1):  # every square is reported once, when its last word comes
                    assert w[x - 2 * q + 1 : x - q + 1] == w[x - q + 1 : x + 1] and (q, x) not in seen
                    seen.add((q, x))
            a += step
        assert [tuple(r) for r in c.runs().tolist()] == runs_by_hand(w, least_words, least)
        if least == 2:
            primitive = lambda u: not any(len(u) % d == 0 and u == u[:d] * (len(u) // d) for d in range(1, len(u)))
            for q in range(1, len(w) // 2 + 1):
                for x in range(2 * q - 1, len(w)):
                    u = w[x - q + 1 : x + 1]
                    assert (q, x) in seen or u != w[x - 2 * q + 1 : x - q + 1] or not primitive(u)


def test_equal_names_of_unequal_blocks_do_no_harm(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_mixed", lambda x: x & np.uint64(1))
    for w in streams(11, 200):
        assert [tuple(r) for r in periodic_runs.runs_of([np.array(w, np.int64)])[0].tolist()] == runs_by_hand(w)


def digests_by_hand(i, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = runs_by_hand(w)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    lead = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
    return (i, len(runs), *lead, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_periodic_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "é", " x", "Zz", "\x1c"])
    rows = [(i, rng.choice(BLANK).join(word() for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(None, "a a a a a a a"), (None, None), (401, ""), (402, " \n"), (403, "no end " * 3000), (403, "no end " * 3000), (404, "x" * 100_000), (405, " la  la\tla la la la la"), *((1000 + k, f"{k} " * 9 + "one two three " * 5) for k in range(60))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, runs string").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op12(spark, str(tmp_path)).collect()]
    small = [r for r in rows if len(r[1] or "") < 15_000]
    want = Counter(digests_by_hand(*r) for r in small)
    assert Counter(r for r in got if r[0] not in (403, 404)) == Counter({k: v for k, v in want.items() if k[0] not in (403, 404)})
    assert sum(r[1] > 0 for r in got) > 50
    long = [r for r in got if r[0] == 403]
    assert len(long) == 2 and long[0][1:6] == (1, 0, 6000, 2, 3_000_000) and long[0][7] == sha("no end")
    assert periodic_runs.find_runs(df.limit(0)).count() == 0


def tree_by_hand(rows):
    """Every row's digests as told, one by one."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, k):
        for level in levels[:-1]:
            s = k // 16 * 16
            yield level[s:k], level[k + 1 : s + 16]
            k //= 16

    def changed(r):
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            return (*r[:4], lower(r[4]))
        return r

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [climb([leaf(r) for r in by[s]]) for s in names]
    top = climb([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps = [*path(trees[k], i), *path(top, k)]
            d, copied = leaf(changed(r)), []
            for a, b in steps:
                d = sha("".join(a) + d + "".join(b))
                copied.append(d)
            proof = sha("".join(x for a, b in steps for x in (*a, *b)))
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], proof, d, d == top[-1][0], tuple(copied) if changed(r) != r else ()))
    return Counter(out)


@pytest.mark.parametrize("levels,sources", [(1, 40), (2, 3), (3, 300)])
def test_manifest_equals_brute_force(spark, tmp_path, levels, sources):
    rng = random.Random(levels)
    pick = ["hot", "hot", "hot", None, "", "é", *(f"s{k}" for k in range(sources))]
    text = lambda: rng.choice([None, "", "ABC é", "abc", "A:1", "Ünï Code X"])
    rows = [(i, rng.choice(pick), rng.choice([None, "en"]), rng.choice([None, 7]), text()) for i in range(700)]
    rows += [(None, "hot", None, None, "Null"), (None, None, None, None, None), rows[3], rows[3], (5, "lone", "", 0, "A" * 200_000), (10**12, "hot", "x", -1, "B")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("g", "i", "n", "digest", "path", "part", "block")}).repartition(5)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", line_dedup.UPPER, line_dedup.LOWER)).otherwise(F.col("text"))
    found = merkle.manifest(df, altered={"text": tampered}, proofs=True, levels=levels).collect()
    got = Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"], tuple(r["copied"])) for r in found)
    assert got == tree_by_hand(rows)
    assert all(merkle.check(r["leaf"], r["proof"], r["root"]) for r in found)
    assert {r["verified"] for r in found} == {True, False} and all(r["copied"][-1] == r["folded_root"] for r in found if r["copied"])
    query = queries.op11(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:7] for r in query) == Counter(k[:7] for k in got.elements())
    assert merkle.manifest(df.limit(0)).count() == 0


def test_manifest_of_one_leaf(spark):
    df = spark.createDataFrame([(1, "a", None, None, "x")], DOCS)
    r = merkle.manifest(df, altered={"text": F.lit("y")}).first()
    assert r["root"] == r["leaf"] == r["subroot"] and r["proof_sha256"] == sha("") and r["folded_root"] == r["altered_leaf"] != r["root"] and not r["verified"]
