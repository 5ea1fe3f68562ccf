"""Operators on texts against brute force, and the defined results of odd inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

import corpus_pipeline
from tidewright.llm import common, decontaminate, language_id, shingle_sets, simhash, suffix_dedup, token_count, token_shards, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ta", "ri", "mo", "sel", "vun", "pra", "ko") for b in ("na", "lek", "dor", "mi", "sha", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    shared = prose(rng, 50)
    texts += [texts[3], texts[3], texts[7] + " tail", "lead " + texts[7], prose(rng, 9) + " " + shared + " x", shared + prose(rng, 30), shared * 3]
    texts += [None, "", "   ", "é" * 150, "a" * 700, "日本語 " * 60]
    rows = [(i, t, "xx", None if i % 11 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[5], None, None, 0), (None, "solo text here", None, None, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumn("row", F.lit("clash")).withColumn("data", F.lit(1)).repartition(5)


def removed(texts, length):
    """Brute force: mask of bytes that lie in a string of length bytes that starts at another place too."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return out


@pytest.mark.parametrize("length,block", [(200, 4 << 20), (200, 900), (40, 2000), (7, 1 << 20)])
def test_suffix_dedup_equals_brute_force(spark, docs, length, block):
    rows = corpus()
    texts = [(t or "").encode() for _, t, *_ in rows]
    want = Counter()
    for (doc_id, *_), t, mask in zip(rows, texts, removed(texts, length), strict=True):
        kept = bytes(b for b, m in zip(t, mask, strict=True) if not m)
        n_spans = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        want[doc_id, len(t), int(mask.sum()), n_spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, length, block)).collect()
    assert Counter(tuple(r) for r in got) == want


def test_cover_holds_every_difference():
    for length in (1, 2, 7, 40, 149, 150, 200):
        v, cover = suffix_dedup.difference_cover(length)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and length - v + 1 >= 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, (1 << 62) - 1), min_size=1, unique=True))
def test_keys_survive_packing(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert (suffix_dedup._keys(suffix_dedup._deltas(keys)) == keys).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 300), min_size=1))
def test_keys_of_all_widths_and_repeated_ones_survive_packing(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert (suffix_dedup._keys(suffix_dedup._deltas(keys)) == keys).all()


def test_suffix_keys_and_pairs_take_few_bytes():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 33, 3000, dtype=np.uint64))
    assert len(suffix_dedup._deltas(keys)) < 3.1 * len(keys)
    first, second = rng.integers(0, 1 << 64, (2, 20000), dtype=np.uint64)
    for bits in (0, 4):
        deal = suffix_dedup._Pairs(first, second, bits)
        rows = list(deal.rows())
        assert len(rows) == 1 << bits and sum(len(b) for _, b in rows) < 14.6 * 20000
        found = [(int(b) << 64 - bits | a, c) for b, blob in rows for a, c in suffix_dedup._read_pairs(blob).tolist()]
        assert found == sorted(zip(first.tolist(), second.tolist(), strict=True))


def test_suffix_dedup_stays_exact_when_fingerprints_collide(spark, docs):
    want = Counter(tuple(r) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs, 40, 3000)).collect())
    for bits in (3, 9):
        assert Counter(tuple(r) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs, 40, 3000, bits)).collect()) == want
    first, second = np.array([5, 5, 5, 1 << 63, 5], np.uint64), np.array([1, 2, 1, 7, 3], np.uint64)
    deal = suffix_dedup._Pairs(first, second, 0)
    ((bucket, blob),) = deal.rows()
    assert bucket == 0 and suffix_dedup._read_pairs(blob).tolist() == [[5, 1], [5, 2], [5, 3], [1 << 63, 7]] and deal.repeated({}).tolist() == [True, False, True, False, False]
    assert [b for b, _ in suffix_dedup._Pairs(first, second, 1).rows()] == [0, 1]
    assert suffix_dedup._tied(np.array([[5, 1], [5, 2], [5, 1], [6, 2]], np.uint64)).tolist() == [True, False, True, False]


def test_suffix_dedup_of_nothing(spark, docs):
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def reference_fingerprint(text, n=4):
    """The contract's words, one hash at a time."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "A b C", "Ünder ÉCOLE a b", "a\x0bb\x0cc\rd e f g", "x y z w " * 5, "word " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == reference_fingerprint(text)


def classes(fps, limit):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("seed", [0, 1])
def test_links_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = classes(fps, 4)
    got = [roots.get(f, f) for f in signed]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_components_are_carried_over(spark, monkeypatch):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(200)]
    further = [(rng.randrange(400), rng.randrange(400)) for _ in range(60)]
    first, second = (spark.createDataFrame(x, "a long, b long") for x in (chain, further))
    labels = common.components(first)
    want = {r["node"]: r["root"] for r in common.components(first.union(second)).collect()}
    got = {r["node"]: r["root"] for r in common.regrouped(labels, second).collect()}
    assert got.keys() == want.keys()
    assert len({(want[n], got[n]) for n in want}) == len(set(want.values())) == len(set(got.values()))
    written, kept = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: written.append(name) or kept(df, name))
    assert len({r["root"] for r in common.regrouped(labels, spark.createDataFrame([(0, 200), (5, 300)], "a long, b long")).collect()}) == 1
    assert len(written) <= 5


def test_large_keys_are_split(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(simhash, "DIRECT", 16)
    fps = np.array(sorted({(rng.getrandbits(20) << 44) >> 44 ^ (1 << rng.randrange(30)) for _ in range(600)}), np.uint64)
    parent, out = np.arange(len(fps)), []
    simhash._link(fps, np.zeros(len(fps), np.uint64), np.arange(len(fps)), list(range(43)), 4, parent, out)
    want = classes([int(f) for f in fps], 4)
    got = [simhash._find(parent, i) for i in range(len(fps))]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got)) and len(out) == len(fps) - len(set(want))


def test_near_duplicates(spark, docs):
    rows = corpus()
    fps = [reference_fingerprint(t) for _, t, *_ in rows]
    cls = classes(fps, 4)
    least = {}
    for c, (i, *_) in zip(cls, rows, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = Counter((i, f"{f:016x}", least.get(c)) for (i, *_), f, c in zip(rows, fps, cls, strict=True))
    assert Counter(tuple(r) for r in simhash.digest(simhash.near_duplicates(docs)).collect()) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({i: 1 for i in [*least.values(), *([None] if any(c not in least for c in cls) else [])]})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def jaccard_classes(texts):
    """Components of all pairs whose five-word Jaccard similarity is 0.8 or more, pair by pair."""

    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(seed=5):
    """Chains of copies with some words changed, around a similarity of 0.8; all share a passage; many copies of one text; a long text and its part."""
    rng = random.Random(seed)
    shared, texts = prose(rng, 12), []
    for n in (14, 60, 150, 400):
        for _ in range(4):
            w = prose(rng, n).split()
            for _ in range(5):
                texts.append(shared + " " + " ".join(w))
                for at in rng.sample(range(n), max(1, n // rng.choice([40, 55, 75]))):
                    w[at] = f"new{rng.random()}"
    base = prose(rng, 90).split()
    for _ in range(90):
        k, m = rng.randint(0, 85), rng.randint(0, 85)
        texts.append(" ".join(f"e{rng.random()}" if i in (k, m) else x for i, x in enumerate(base)))
    whole = prose(rng, 104).split()
    texts += [" ".join(whole), " ".join(whole[:84]), " ".join(whole[:83]), "a b", "A  b", "a b c", None, " "]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, "alone and without an id")]


@pytest.mark.parametrize("direct,block", [(16, 4096), (1000, 8), (2, 5)])
def test_similar_texts_equal_all_pairs(spark, monkeypatch, direct, block):
    monkeypatch.setattr(shingle_sets, "DIRECT", direct)
    monkeypatch.setattr(shingle_sets, "BLOCK", block)
    monkeypatch.setattr(shingle_sets, "PER_TASK", 2000)
    monkeypatch.setattr(shingle_sets, "RUN", 7)
    rows = edited()
    cls = jaccard_classes([t for _, t in rows])
    least = {}
    for c, (i, _) in zip(cls, rows, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(5)
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df, 5, similarity=0.8).collect())
    assert got == Counter((i, least.get(c)) for (i, _), c in zip(rows, cls, strict=True))
    kept = simhash.keep_one(df, words=5, similarity=0.8)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([*least.values(), None])
    assert simhash.near_duplicates(df.limit(0), 5, similarity=0.8).count() == 0


def test_pipeline_keeps_one_of_pairs_of_similarity_08(spark):
    texts = [t for _, t in edited()[:80]]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = corpus_pipeline.one_of_near_duplicates(spark, df, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(jaccard_classes(texts)))


BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "  two  spaces ", "a\n\nb", "a \n b", "tab\there", "nb sp", "x\x1cy !\x1c! z", "it's THEY'RE I'll", "<|endoftext|> a <|endoftext|>b", "<|ENDOFTEXT|>", "<|startoftext|>x", "Ünïcode Straße ΣΑΣ", "é ́x", "日本語 テキスト", "🙂🙂 ok", "word,. (x). a... b!? c,", "1234 5,6", "\r\nline\r\n", "ends in space ", "﻿bom"]
SAMPLE = [*ODD, *(t or "" for _, t, *_ in corpus()), " ".join(ODD) * 40]


def test_styles_follow_from_the_settings(tmp_path):
    assert [tokens.style_of(p) for p in (BYTE, WORD, PIECE)] == ["leads", "drops", "pieces"]
    other = Tokenizer.from_file(BYTE)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "byte_bpe_prefix.json"))
    assert tokens.style_of(str(tmp_path / "byte_bpe_prefix.json")) == "whole"


@pytest.mark.parametrize("path", [BYTE, PIECE, WORD])
def test_token_counts(spark, path):
    want = [len(x) for x in tokens.encode(path, SAMPLE)]
    rows = [(i, t) for i, t in enumerate(SAMPLE)] + [(None, None), (3, SAMPLE[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("data", F.lit(1)).withColumn("n_tokens", F.lit("clash"))
    out = token_count.count_tokens(df, path, 100)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows) and [got[i]["n_tokens"] for i in range(len(SAMPLE))] == want
    assert got[None]["n_tokens"] == 0 and all(r["over_limit"] == (r["n_tokens"] > 100) for r in got.values())
    assert got[0]["n_bytes"] == 0 and token_count.count_tokens(df.limit(0), path).count() == 0


TEXTS = st.text(alphabet=st.sampled_from("aBz09é .,\n\t'!-<|>\x1c\u0301日ſ"), max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", "it's", "A.B", " 12,", "x\n", "ÀÉ"]), max_size=6).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_words_and_lengths_equal_the_library(texts):
    raw = [t.encode() for t in texts]
    assert list(tokens.ids(WORD, raw, "<u2")) == [np.array(x, "<u2").tobytes() for x in tokens.encode(WORD, texts)]
    for path in (BYTE, PIECE):
        assert tokens.lengths(path, raw).tolist() == [len(x) for x in tokens.encode(path, texts)]


@pytest.mark.parametrize("path", [BYTE, WORD, PIECE])
def test_long_texts_are_cut_safely(monkeypatch, path):
    monkeypatch.setattr(tokens, "PART", 50)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 200)
    text = " ".join(ODD) * 5
    assert len(tokens.parts(text, tokens.style_of(path))) > 5 and tokens.parts(text, "whole") == [text]
    want = tokens.encode(path, [text, "", "x"])
    assert list(tokens.ids(path, [text.encode(), None, b"x"], "<u2")) == [np.array(x, "<u2").tobytes() for x in want]
    assert tokens.lengths(path, [text.encode(), None, b"x"]).tolist() == [len(x) for x in want]


def test_a_full_table_of_words_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    table = tokens.Words(WORD, "<u4")
    for k in range(4):
        part = [t for t in SAMPLE[k::4]]
        assert list(table.encode([t.encode() for t in part])) == [np.array(x, "<u4").tobytes() for x in tokens.encode(WORD, part)]


@pytest.mark.parametrize("tokenizer", [WORD, BYTE, PIECE])
def test_shards_round_trip(spark, monkeypatch, tokenizer):
    monkeypatch.setattr(token_shards, "BLOCK_BYTES", 300)
    rng = random.Random(4)
    rows = [(rng.randint(-50, 3000), t) for t in SAMPLE] + [(None, "null id"), (7, None), (7, "again"), (7, "again"), (1 << 62, "far"), (-(1 << 62), "far")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash"))
    manifest = token_shards.write_shards(df, tokenizer, 1, shard_bytes=4000).cache()
    assert manifest.count() > 2
    encoded = lambda t: tokens.encode(tokenizer, [t or ""])[0] + [1]
    got = token_shards.read_shards(manifest).orderBy("start").collect()
    assert Counter((r["doc_id"], r["ids"]) for r in got) == Counter((i, np.array(encoded(t), "<u4").tobytes()) for i, t in rows)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    starts = np.cumsum([0, *(r["n_tokens"] for r in got)])
    assert [r["start"] for r in got] == starts[:-1].tolist()
    d = token_shards.digest(token_shards.read_shards(manifest)).where("start = 0").first()
    assert d["ids_crc32"] == zlib.crc32(got[0]["ids"])
    wanted = sorted({i for i, _ in rows if i is not None})
    asked = spark.createDataFrame([(i,) for i in wanted + [99999, None, 7, 1 << 63 - 1, -(1 << 63)]], "doc_id long")
    found = Counter((r["doc_id"], r["tokens"]) for r in token_shards.find(manifest, asked).collect())
    assert found == Counter((r["doc_id"], r["ids"]) for r in got if r["doc_id"] is not None)
    fs, path = pafs.FileSystem.from_uri(manifest.first()["file"])
    shard = token_shards.Shard(fs, path)
    assert shard.n == manifest.first()["n_docs"] and shard.tokens == manifest.first()["n_tokens"] and shard.get(10**12) == []
    nothing = token_shards.write_shards(df.limit(0), tokenizer, 1)
    assert token_shards.read_shards(nothing).count() == 0 and token_shards.find(nothing, asked).count() == 0


def slow_tiles(p, t, least):
    """Greedy string tiling: always the longest common run of free words, ties by place in p, then in t."""
    fp, ft, done = [True] * len(p), [x != 0 for x in t], []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and fp[i + n] and ft[j + n] and p[i + n] == t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sorted(done)
        fp[i : i + n] = [False] * n
        ft[j : j + n] = [False] * n
        done.append((i, j, n))


def test_tiles_equal_slow_tiling():
    for seed in range(80):
        rng = random.Random(seed)
        p = [rng.randint(1, 4 + seed % 5) for _ in range(rng.randint(1, 30))]
        t = [rng.randint(0, 4 + seed % 5) for _ in range(rng.randint(0, 40))] + p[5:12] + p[:6]
        assert decontaminate.tiles(np.array(p, np.uint64), np.array(t, np.uint64), 1 + seed % 4) == slow_tiles(p, t, 1 + seed % 4)


def test_decontamination_equals_tiling_all_pairs(spark):
    rng = random.Random(12)
    common = prose(rng, 8)  # in every item and document
    items = [common + " " + prose(rng, n) for n in (4, 9, 20, 45)] + [common, "one", "two words", "four words of item", ""]
    texts = []
    for k in range(60):
        w = items[k % 5].split()
        cut = rng.randint(0, len(w))
        drop = rng.randint(0, len(w))
        texts.append(" ".join([prose(rng, rng.randint(0, 9)), *w[cut:], prose(rng, 3), *[x for i, x in enumerate(w[:cut]) if i != drop], common if k % 3 else ""]))
    texts += ["one", "it is one of two words", "four words of an item", "x four words of item", ""]
    split = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    number = {w: i + 1 for i, w in enumerate(sorted({w for t in texts + items for w in split(t)}))}
    want = {}
    for d, t in enumerate(texts):
        for i, p in enumerate(items):
            a, b = [number[w] for w in split(p)], [number[w] for w in split(t)]
            found = slow_tiles(a, b, min(5, len(a))) if a else []
            if a and sum(n for *_, n in found) / len(a) >= 0.8:
                want[d, i] = (pytest.approx(sum(n for *_, n in found) / len(a)), len(found))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = decontaminate.tile_matches(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_tiles"]) for r in got.collect()} == want and len(want) > 20


def test_decontamination(spark):
    rng = random.Random(9)
    items = [prose(rng, 30) for _ in range(4)] + ["too short", None, ""]  # no text holds the short one whole
    w = items[0].split()
    texts = {
        1: prose(rng, 40) + " " + items[1] + " " + prose(rng, 40),
        2: " ".join(w[15:]) + " ... " + prose(rng, 10) + " " + " ".join(w[:15]),  # parts in another order
        3: items[2].upper().replace(" ", ",\n"),
        4: prose(rng, 80),
        5: " ".join(w[:12]) + " " + prose(rng, 60),  # less than the coverage
        6: None, 7: "", 8: prose(rng, 20000) + " " + items[3],
    }
    df = spark.createDataFrame([(i, t, "c") for i, t in texts.items()] + [(None, items[1], "c"), (4, items[3], "c")], "doc_id long, text string, item_id string").withColumns({n: F.lit("clash") for n in ("_id", "_text", "id", "row", "text_hash", "uid")})
    bench = spark.createDataFrame(list(enumerate(items)) + [(0, items[0])], "item_id long, text string")
    found = decontaminate.tile_matches(df, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 1), (2, 0), (3, 2), (8, 3), (None, 1), (4, 3)}
    two = found.where("doc_id = 2").first()
    assert two["n_tiles"] == 2 and two["coverage"] == 1.0 and sum(t["n_words"] for t in two["tiles"]) == 30
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7]
    assert decontaminate.tile_matches(df.limit(0), bench).count() == 0 and decontaminate.tile_matches(df, bench.limit(0)).count() == 0


SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.train(df.where(~held))
    out = language_id.identify(df.where(held), model, keep=("lang",))
    rows = out.collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 and abs(sum(r["proportions"].values()) - 1) < 1e-6 for r in rows if r["lang_pred"] != "und")


def test_language_mixtures_and_odd_texts(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(df)
    by = {r["lang"]: r["text"] for r in df.where("n_chars > 3000").dropDuplicates(["lang"]).collect()}
    mixed = by["de"][:1500] + " " + by["es"][:1500]
    rows = [(1, mixed), (2, None), (3, ""), (4, "123 !? 456"), (5, by["fr"] * 200), (6, "the"), (None, by["en"]), (6, "the")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("data", F.lit(0)), model).collect()
    one = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and {k for k, v in one[1]["proportions"].items() if v > 0.25} == {"de", "es"}
    assert [one[i]["lang_pred"] for i in (2, 3, 4, 5, None)] == ["und", "und", "und", "fr", "en"] and one[2]["score"] == 0
    nothing = language_id.train(df.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(df.limit(3), nothing).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0


def test_mixtures_equal_slow_inference(spark):
    """Every document by itself, word by word, in plain loops."""
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    by = {r["lang"]: r["text"] for r in df.where("lang IS NOT NULL AND n_chars > 900").dropDuplicates(["lang"]).collect()}
    langs = list(by)
    extra = [(1000 + k, by[a][:700] + " | " + by[b][:300]) for k, (a, b) in enumerate((a, b) for a in langs for b in langs if a != b)]
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()] + extra + [(2000, "x"), (2001, "da da"), (2002, None)]

    def slow(text):
        low = [b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").lower().encode()]
        words = bytes(low).split()
        like = []
        for w in words:
            padded = b" " + w + b" "
            ll = np.zeros(len(model.langs))
            for i in range(len(w)):
                a, b, c = padded[i : i + 3]
                ll = ll + model.logp[((a << 16 | b << 8 | c) * 0x9E3779B1 % (1 << 32)) >> 17]
            like.append(0.98 * np.exp((ll - ll.max()).astype(float)) + 0.02)
        if not words:
            return None
        total = lambda pi: sum(math.log(float(x @ pi)) for x in like)
        one = [sum(math.log(x[k]) for x in like) for k in range(len(model.langs))]
        pi = np.eye(len(model.langs))[int(np.argmax(one))]
        best = max(one)
        while len(words) > 1 and (pi == 0).any():
            gain = [sum(x[k] / float(x @ pi) for x in like) if pi[k] == 0 else -1 for k in range(len(pi))]
            n = (pi > 0).sum()
            trial = pi * n / (n + 1)
            trial[int(np.argmax(gain))] = 1 / (n + 1)
            for _ in range(6):
                trial = sum(x * trial / float(x @ trial) for x in like) / len(like)
            if 2 * (total(trial) - best) <= 4.0 * math.log(max(len(words), 2)):
                break
            pi, best = trial, total(trial)
        return pi

    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    several = 0
    for i, t in rows:
        pi = slow(t)
        if pi is not None:
            several += (pi > 0).sum() > 1
            found = [got[i]["proportions"].get(x, 0.0) for x in model.langs]
            assert found == pytest.approx(pi.tolist(), abs=2e-3)
    assert several > 8 and got[2002]["lang_pred"] == "und"


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    df = spark.createDataFrame([(k, "text", f"l{k}") for k in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="3 distinct"):
        language_id.train(df)


CLASHES = ("row", "data", "_stay", "_again", "id", "again", "fp", "size", "copies", "q", "h", "lang_pred", "score")


def clashing(df):
    return df.withColumns({n: F.lit("clash") for n in CLASHES})


def odd_docs(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 250").select(*[x.split()[0] for x in DOCS.split(", ")])
    long = " ".join(r["text"] for r in docs.where("lang = 'en'").limit(40).collect()) * 3
    odd = [(9001, "12 34", "en", "src1", 5), (9002, None, None, None, 0), (9003, "", "en", None, 0), (9004, long, None, "src1", 0), (None, long + " tail of it", "en", "src1", 0), (9005, "so here it is " + bench, "en", "src2", 0), (None, None, None, None, None)]
    again = docs.where("doc_id IN (3, 4)")
    return clashing(docs.unionByName(spark.createDataFrame(odd, DOCS)).unionByName(again)).cache(), bench


def test_pipeline_stages(spark):
    """Each stage against what brute force keeps of its own input, with nulls, repeats, a very long text and clashing names."""
    docs, _ = odd_docs(spark)
    (_, lang), (_, near), (_, clean), (_, mixed), (_, out) = corpus_pipeline.STAGES
    a = lang(spark, docs, SF).cache()
    gone = {r["doc_id"] for r in docs.select("doc_id").subtract(a.select("doc_id")).collect()}
    assert a.columns == docs.columns and gone >= {9001, 9002, 9003} and a.count() > 240 and a.where("doc_id = 9004 OR doc_id IS NULL").count() == 2
    rows = a.orderBy("doc_id").collect()
    cls = jaccard_classes([r["text"] for r in rows])
    least = {}
    for c, r in zip(cls, rows, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    b = near(spark, a, SF).cache()
    assert b.columns == docs.columns and sorted(r["doc_id"] for r in b.collect()) == sorted(least.values()) and 9004 in least.values()
    c = clean(spark, b, SF).cache()
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r["doc_id"] for r in b.collect() if any(t in r["text"] for t in bench)}
    assert c.columns == docs.columns and 9005 in dirty and {r["doc_id"] for r in b.collect()} - {r["doc_id"] for r in c.collect()} >= dirty
    m = mixed(spark, c, SF).cache()
    assert m.columns == docs.columns and max(r["count"] for r in m.groupBy("doc_id").count().collect()) <= 2
    got = out(spark, m, SF)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in m.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_runs_as_its_stages(spark, tmp_path):
    docs, _ = odd_docs(spark)
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, str(tmp_path)).cache()
    got = corpus_pipeline.run(spark, str(tmp_path))
    rows = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got.collect())
    assert rows == sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in want.collect())
    starts = np.cumsum([0, *(r[2] for r in rows)])
    assert [r[0] for r in rows] == starts[:-1].tolist() and len(rows) > 200


def test_keep_one_with_clashing_names(spark):
    df = clashing(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, "x")], "doc_id long, text string"))
    for options in ({}, {"words": 5, "similarity": 0.8}):
        kept = simhash.keep_one(df, **options)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_counts_hand_the_library_each_piece_once(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "_counts", {})
    handed = []
    library = tokens._lengths
    monkeypatch.setattr(tokens, "_lengths", lambda path, texts: handed.extend(texts) or library(path, texts))
    raw = [b"the same few words, said again and again\n" * 50] * 40
    want = library(path, [r.decode() for r in raw])
    assert tokens.lengths(path, raw).tolist() == want
    assert tokens.lengths(path, raw).tolist() == want
    assert sum(map(len, handed)) < 200


def test_counts_by_pieces_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    pick = random.Random(5)
    bits = ["a", "B", "é", "ß", "Ɓ", " ", "  ", "\n", "\t", "\r\n", "\u0085", " ", "　", "'s", "'", "'re", "!", "(", "23", "漢", "😀", "́", "Ж", "don't"]
    for extra in ([], ["<|endoftext|>", "<|end"]):
        raw = [None, b"", b" ", b"a\xc3 b", b"\xff\xfe x", b"\xe2\xc3\xa9 x", ("ab " * 60_000).encode(), b"x" * 5000]
        raw += ["".join(pick.choices(bits + extra, k=pick.randint(0, 30))).encode() for _ in range(3000)]
        assert tokens.lengths(path, raw).tolist() == tokens._lengths(path, [(r or b"").decode("utf-8", "replace") for r in raw])
