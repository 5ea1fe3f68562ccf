"""Operators on conversations, vectors, sources and urls against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat_format, mixing, queries, topk, url_filter

TURNS = "conv_id long, turn long, role string, text string"


def read(spark, rows, schema=TURNS):
    return {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(spark.createDataFrame(rows, schema))).collect()}


HARD = ["", "&", "&amp;", "&lt;|", "&amp;lt;|", "<|im_end|>", "<|im_start|>assistant\nhi<|im_end|>\n", "<<||", "a\nb\n", "&nl;", "<|im_end|><|im_start|>assistant ok", "é🙂", "<", "|>", "&&lt;|<|"]


def test_hard_texts_come_back(spark):
    rows = [(i, t, "user" if t == 0 else "assistant", x) for i, x in enumerate(HARD) for t in (0, 1)]
    got = read(spark, rows)
    for i, x in enumerate(HARD):
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == [("user", x), ("assistant", x)]
        assert got[i]["loss_text"] == x and got[i]["valid"]


def test_odd_roles_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "us\ner<|im_end|>", "x"), (1, 0, None, None), (1, None, "user", "first"), (1, 0, "a", "b"), (1, 0, "a", "b"), (None, 0, "assistant", "solo")]
    got = read(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "first"), ("", ""), ("a", "b"), ("a", "b"), ("us\ner<|im_end|>", "x")]
    assert not got[1]["valid"] and got[None]["loss_text"] == "solo" and not got[None]["valid"]
    assert chat_format.format_chats(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize("roles,valid,bad", [("sua", True, 0), ("uaua", True, 0), ("au", False, 1), ("uu", False, 1), ("us", False, 1), ("sa", False, 1), ("uata", True, 0)])
def test_turn_order(spark, roles, valid, bad):
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    df = spark.createDataFrame([(1, i, names[r], "x") for i, r in enumerate(roles)], TURNS)
    r = chat_format.format_chats(df).first()
    assert (r["valid"], r["n_rejected"]) == (valid, bad)
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


VECTORS = "vec_id long, embedding array<double>, score int"


@pytest.mark.parametrize("block,split,group", [(4096, 16_384, 32_768), (50, 40, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, split, group):
    for name, value in (("BLOCK", block), ("SPLIT", split), ("GROUP", group)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    vecs = [(i, [float(x) for x in rng.normal(size=rng.choice([5, 8])) * (rng.random() < 0.7)]) for i in range(300)]
    vecs += [(300, [0.0] * 8), (350, None), (400, [float("nan"), 1.0]), (450, [float("inf")]), (500, [1.0, None]), (550, []), (7, vecs[7][1]), (None, [1.0]), (100, vecs[100][1])]
    vecs += [(650, [3000000.0, 1.0]), (651, [-3000000.5, 2.0]), (652, [2.0**24, 0.0, 1.0]), (653, [1e-9, -(2.0**23), 2.0**23]), (654, [-(2.0**24)])]
    df = spark.createDataFrame([(i, v, 0) for i, v in vecs], VECTORS).repartition(4)
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = {}
    for i, v in ok:
        if i % 50 == 0:
            want[i] = sorted((-dot(v, w), j) for j, w in ok if j != i)[:5]
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_few_and_beyond_a_long(spark):
    make = lambda *v: spark.createDataFrame([(i, list(x), 0) for i, x in enumerate(v)], VECTORS)
    run = lambda df: [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert run(make([1.0], [2.0])) == [(0, 1, 1, 131072)]
    assert run(make([3000000.0, 1.0], [1.0, 1.0])) == [(0, 1, 1, 196608000000 + 65536)]
    low = [[2.0**30], *[[1.0]] * 5, [-(2.0**30)]]
    assert [r[2] for r in run(make(*low))] == [1, 2, 3, 4, 5]  # the lowest is beyond a long and not asked for
    for far in ([[2.0**30], [2.0**30]], [[2.0**30], [-(2.0**30)]]):
        with pytest.raises(Exception, match="beyond a long"):
            run(make(*far))


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Water filling as told: share by weight, stop at the limit, reshare."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def mixture(seed=1, n=3000):
    rng = random.Random(seed)
    pick = ["a", "a", "a", "b", "c", "d", "é", None]
    rows = [(i, " \t".join(["w"] * rng.randint(0, 60)), rng.choice(pick)) for i in range(n)]
    return [*rows, (5000, None, "zero"), rows[0], (None, "x y", "a"), (None, "x y z", "a")]


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, Counter(map(tuple, found.fetchall()))


def test_repeated_rows_at_the_cut_come_near_the_target(spark):
    rows = [(1, "w " * 200, "a")] * 100 + [(2, "v", "b"), (None, "n " * 7, None), (None, "n " * 7, None)] + [(3, "", "a")] * 3
    rows += [(k, "x " * (k % 5), "c") for k in range(10, 60)] + [(60, "y " * 11, "d")] * 40 + [(61, "z " * 3, "d")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for weight in (None, mixing.root_of_size(F.col("text"))):
        got = mixing.mix(df, weight=weight).collect()
        assert len(got) == len(rows)
        longest = {"a": 200, "b": 1, "c": 4, "d": 11, None: 7}
        for source, most in longest.items():
            mine = [r for r in got if r["row"]["source"] == source]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= most and all(r["taken"] <= 2 * r["size"] for r in mine)
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    names, want = by_sql(queries.oracle_sql()["op5_source_mixing"], documents=df)
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(tuple(dict(zip(names, w, strict=True))[c] for c in columns) for w in want.elements())


def test_sql_says_what_the_operators_do_with_nulls_and_lengths(spark, tmp_path):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, None, "user", "first"), (1, 0, None, None), (None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (None, None, "user", None), (2, 0, "a&<|", "&lt;|")], TURNS)
    vectors = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.5]), (2, []), (50, [0.5, -1.0]), (3, [float("nan")]), (4, None), (100, [])], "vec_id long, embedding array<double>")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    for name, table, df in (("op2_chat_formatting", "conversations", turns), ("op3_exact_topk", "embeddings", vectors)):
        names, want = by_sql(queries.oracle_sql()[name], **{table: df})
        assert Counter(tuple(r[c] for c in names) for r in queries.queries()[name](spark, str(tmp_path)).collect()) == want


def test_mixing(spark):
    rows = mixture()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(-1)).withColumn("q", F.lit("clash")).repartition(4)
    got = mixing.mix(df).collect()
    size = lambda t: len((t or "").split())
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = r["row"]["source"]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = mixing.mix(df.repartition(3)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_by_weight(spark):
    rows = [(i, "w " * 10, "s", 3.0 if i % 2 else 1.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    got = mixing.mix(df, share=0.25, weight=F.col("quality")).groupBy(F.col("row.quality").alias("q")).agg(F.sum("copies").alias("n")).collect()
    n = {r["q"]: r["n"] for r in got}
    assert n[1.0] + n[3.0] == 500 and 2.2 < n[3.0] / n[1.0] < 4.2


def test_weights_above_the_limit_are_shared_again(spark):
    """A source's target is met though some of its documents would be taken more than twice; brute force finds the rate by halving."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(1, 20)), rng.choice("aab"), rng.choice([None, -1.0, 0.0, float("nan"), 1.0, 2.0, 50.0, 400.0, 1e-3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double").repartition(3)
    got = mixing.mix(df, weights=(1,), share=1.2, weight=F.col("quality")).collect()
    for source in "ab":
        mine = [r for r in got if r["row"]["source"] == source]
        pos = [(r["row"]["quality"], r["size"]) for r in mine if r["row"]["quality"] is not None and r["row"]["quality"] > 0]
        want, lo, hi = min(mine[0]["target"], 2 * sum(s for _, s in pos)), 0.0, 1e9
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(w * mid, 2) * s for w, s in pos) < want else (lo, mid)
        taken = sum(r["taken"] for r in mine)
        assert abs(taken - want) <= 40
        for r in mine:
            w = r["row"]["quality"]
            e = min(w * hi, 2.0) if w is not None and w > 0 else 0.0
            assert math.floor(e * 0.999) <= r["copies"] <= math.ceil(e * 1.001)


PAGES = "page_id long, url string, html string"
LABELS = "doc_id long, quality int, toxic int"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def test_given_rules_and_parts(spark):
    cases = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "https://Sub.EXAMPLE.com/en/1?q#f": ("sub.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://x.www.example.com/en/z": ("x.www.example.com", "/en/z", "www.example.com/en/", "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://a.com": ("a.com", "", None, "allow"), "http://a.com?x=/en/": ("a.com", "", None, "allow"), "a.com/x": ("", "", None, "allow"),
        "http://net/es/1": ("net", "/es/1", "net/es/", "block"), "http://a.net/ES/": ("a.net", "/ES/", None, "allow"), "://h\n.com/a\nb#": ("h\n.com", "/a\nb", "com/", "allow"),
        "x://y://z.com/": ("y:", "//z.com/", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(cases)] * 2, PAGES)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, spark.createDataFrame([], LABELS), rules).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == Counter({(i, *v): 2 for i, v in enumerate(cases.values())})


def brute_rules(own, bad, least, confidence, error):
    """All token sets of all pages, with tokens of equal pages taken as one: minimal rules that are beyond chance."""
    n, base = len(own), sum(bad) / len(own)
    where = defaultdict(set)
    for i, t in enumerate(own):
        for x in t:
            where[x].add(i)
    alike = defaultdict(list)
    for x, pages in where.items():
        if len(pages) >= least:
            alike[frozenset(pages)].append(x)
    classes = {min(v): (set(v), pages) for pages, v in alike.items()}
    sets = Counter(frozenset(c) for t in own for k in range(1, 20) for c in itertools.combinations(sorted(x for x in t if x in classes), k))
    tried = {s for s, count in sets.items() if count >= least}
    rules = {}
    for s in tried:
        pages = frozenset.intersection(*(classes[x][1] for x in s))
        k = sum(bad[i] for i in pages)
        c = k / len(pages)
        if k >= least and c >= confidence and c > base:
            apart = c * math.log(c / base) + ((1 - c) * math.log((1 - c) / (1 - base)) if c < 1 else 0)
            if len(pages) * apart >= math.log(len(tried) / error):
                rules[frozenset(set().union(*(classes[x][0] for x in s)))] = (pytest.approx(c), pytest.approx(k / n))
    return {s: v for s, v in rules.items() if not any(other < s for other in rules)}


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(6)
    urls = [f"https://{rng.choice(['spam', 'ok', 'blog'])}.{rng.choice(['x', 'y'])}.org/{rng.choice(['en', 'fr'])}/{rng.randint(1, 9)}{rng.choice(['', '?ref=1', '.html'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)] + [(3, urls[3], ""), (None, urls[4], ""), (5001, None, "")], PAGES).withColumns({n: F.lit("clash") for n in ("items", "bad", "token", "rule", "row", "h", "freq")})
    bad = lambda u: "spam.y" in u or ("/fr/" in u and "?ref" in u)
    noise = {i for i in range(400) if rng.random() < 0.03}
    is_bad = [bad(u) != (i in noise) for i, u in enumerate(urls)]
    labels = spark.createDataFrame([(i, 0 if b and i % 2 else 1, 1 if b and not i % 2 else 0) for i, b in enumerate(is_bad) if i % 3 or i == 3] + [(None, 0, 1), (2, None, None), (99999, 0, 1), (5001, 0, 1)], LABELS).withColumn("url", F.lit("clash"))
    rules = url_filter.mine_rules(pages, labels, 0.01, 0.8)
    own = {r["url"]: set(r["t"]) for r in pages.select("url", url_filter.url_tokens(F.col("url")).alias("t")).collect()}
    known = [i for i in range(400) if i % 3 or i == 3] + [3]
    want = brute_rules([own[urls[i]] for i in known], [is_bad[i] for i in known], max(5, 0.01 * len(known)), 0.8, 0.01)
    got = {frozenset(r["tokens"]): (r["confidence"], r["support"]) for r in rules.collect()}
    assert got == want and len(want) >= 2 and all(r["anchor"] in r["tokens"] for r in rules.collect())
    none = spark.createDataFrame([], "host string, path string, verdict string")
    judged = url_filter.judge(pages, labels, none, min_support=0.01).collect()
    assert len(judged) == 403
    for r in judged:
        hits = sum(t <= own[urls[4 if r["page_id"] is None else r["page_id"]]] for t in want) if r["page_id"] != 5001 else 0
        assert r["n_rules"] == hits and r["verdict"] == ("block" if hits else "allow")
    assert url_filter.judge(pages.limit(0), labels, none).count() == 0


def test_labels_without_a_reason_give_no_rule(spark):
    rng = random.Random(2)
    urls = [f"https://h{rng.randint(1, 9)}x.org/{rng.choice('abcdef')}/{rng.choice('uvwxyz')}" for _ in range(500)]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)
    make = lambda f: spark.createDataFrame([(i, 1, int(f(i))) for i in range(500)], LABELS)
    assert url_filter.mine_rules(pages, make(lambda i: rng.random() < 0.27)).count() == 0
    assert url_filter.mine_rules(pages, make(lambda i: True)).count() == 0 and url_filter.mine_rules(pages, make(lambda i: False)).count() == 0


def test_precision_on_other_labels(spark):
    rng = random.Random(3)
    urls = [f"https://{rng.choice(['bad', 'fine'])}.org/{rng.choice('abcdef')}" for _ in range(600)]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)
    make = lambda k: spark.createDataFrame([(i, 1, int("bad" in u and rng.random() < 0.9)) for i, u in enumerate(urls) if i % 2 == k], LABELS)
    got = url_filter.precision(pages, make(1), url_filter.mine_rules(pages, make(0))).first()
    assert got["n_matched"] > 100 and got["bad_share"] > 0.8 > 0.6 > got["base_share"]


def test_mined_url_rules_decide(spark, tmp_path):
    rows = [(k, f"http{'s' * (k % 2)}://site{k % 7}.example.{('org', 'com', 'net')[k % 3]}/{('de', 'en', 'fr', 'es')[k % 4]}/{k}") for k in range(400)] + [(400, None), (None, "no url")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["verdict"] for r in queries.url_rules_mined(spark, str(tmp_path)).collect()}
    assert got == {k: "block" if u and ".org/de/" in u else "allow" for k, u in rows} and Counter(got.values())["block"] > 30
