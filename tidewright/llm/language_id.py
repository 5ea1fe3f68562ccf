"""Language identification by multilingual mixture inference.

A document is a mixture of languages. Each word gets a likelihood in each language from its
character n-grams; expectation-maximisation estimates the proportions, and the set of languages
is grown one at a time as long as the gain in log-likelihood pays a penalty a language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import sliced

UNKNOWN = "und"
#: Languages that a model may have; more are an error, as labels then are no languages and the model has no bound.
MOST_LANGUAGES = 1000
#: Hashed n-grams: the model has one row of this many entries a language, whatever the corpus.
TABLE = 1 << 15
#: Texts are handled in runs of about so many bytes, which bounds memory.
RUN_BYTES = 1 << 20
#: A likelihood's share of "any text at all", so that junk words decide nothing.
FLOOR = 0.02
ROUNDS = 6
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: log-probability [n-gram, language]
    logp: np.ndarray


def _lower(data: bytes) -> np.ndarray:
    """Bytes of the lower-case text; bytes that no letter has are blanks."""
    b = np.frombuffer(data.decode("utf-8", "replace").lower().encode(), np.uint8)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    return np.where(letter, b, np.uint8(32))


def _grams(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of bytes that end in a word or its closing blank, and the word each belongs to.

    A word is a run of letter bytes; its trigrams include the blanks around it.
    """
    padded = np.concatenate([np.array([32], np.uint8), b, np.array([32, 32], np.uint8)]).astype(np.uint32)
    h = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    mid = padded[1:-1] != 32  # a trigram belongs to the word of its middle byte
    start = mid & (padded[:-2] == 32)
    word = np.cumsum(start)[mid] - 1
    return h[mid].astype(np.int64), word


def _runs(texts: list[bytes | None]):
    """Ranges of texts of about RUN_BYTES each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= RUN_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts n-grams of all rows with a language, in Spark; the model has TABLE numbers a language.

    Null languages and null texts are left out; empty texts, repeated rows and very long texts
    count like any others. Columns besides the two are left out. No rows at all: a model without
    languages. More than MOST_LANGUAGES distinct labels: an error.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("data"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in sliced(batches):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _runs(texts):
                for lang in set(langs[i:j]):
                    data = b"\n".join(t for x, t in zip(langs[i:j], texts[i:j], strict=True) if x == lang and t)
                    c = np.bincount(_grams(_lower(data))[0], minlength=TABLE)
                    total[lang] = total[lang] + c if lang in total else c
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "gram": pa.array(at, pa.int32()), "n": pa.array(c[at], pa.int64())})

    n_langs = rows.select("lang").distinct().count()
    if n_langs > MOST_LANGUAGES:
        raise ValueError(f"{n_langs} distinct languages; the labels need cleaning")
    counts = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most TABLE rows a language
    langs = tuple(sorted(set(table.column("lang").to_pylist()) if table.num_rows else ()))
    n = np.zeros((TABLE, len(langs)))
    if langs:
        at = {x: i for i, x in enumerate(langs)}
        n[np.asarray(table.column("gram")), [at[x] for x in table.column("lang").to_pylist()]] = np.asarray(table.column("n"))
    p = (n + 0.5) / (n + 0.5).sum(axis=0, keepdims=True) if langs else n
    return Model(langs, np.log(p).astype(np.float32))


def _mixture(like: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float) -> np.ndarray:
    """Proportions [document, language] from word likelihoods [word, language], all documents at once.

    like is scaled so that a word's largest entry is 1. Forward selection: a document starts with
    its best single language; each step gives every open document the language of the largest
    first-order gain, runs EM over its set, and keeps the set if twice the gain in log-likelihood
    exceeds penalty * log(words).
    """
    k = like.shape[1]
    words = np.bincount(doc, minlength=n_docs)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    has = doc[first]

    def total(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n_docs, *x.shape[1:]))
        if len(first):
            out[has] = np.add.reduceat(x, first, axis=0)
        return out

    like = (1 - FLOOR) * like + FLOOR
    one = total(np.log(like))
    best = one.argmax(axis=1)
    pi = np.zeros((n_docs, k))
    pi[np.arange(n_docs), best] = 1
    score = one[np.arange(n_docs), best]
    active = words > 1
    for _ in range(1, k):
        live = active[doc]
        if not live.any():
            break
        w, d = like[live], doc[live]
        firsts = np.flatnonzero(np.diff(d, prepend=-1))
        at = d[firsts]
        mixed = np.einsum("ij,ij->i", w, pi[d])
        gain = np.zeros((n_docs, k))
        gain[at] = np.add.reduceat(w / mixed[:, None], firsts, axis=0)
        gain[pi > 0] = -1
        add = gain.argmax(axis=1)
        trial = pi.copy()
        size = (pi > 0).sum(axis=1)
        trial[at] *= (size / (size + 1))[at, None]
        trial[at, add[at]] = 1 / (size[at] + 1)
        for _ in range(ROUNDS):
            r = w * trial[d]
            r /= r.sum(axis=1, keepdims=True)
            trial[at] = np.add.reduceat(r, firsts, axis=0) / words[at, None]
        now = np.full(n_docs, -np.inf)
        now[at] = np.add.reduceat(np.log(np.einsum("ij,ij->i", w, trial[d])), firsts)
        better = active & (2 * (now - score) > penalty * np.log(np.maximum(words, 2)))
        pi[better], score[better] = trial[better], now[better]
        active = better
    return pi


def identify(docs: DataFrame, model: Model, penalty: float = 4.0, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., lang_pred, score, proportions map<string, double>), one row for each row of docs.

    lang_pred: the language of the largest proportion, ties to the earlier name; score: that
    proportion. Null text, no letter, or a model without languages: ``und`` and score 0. Whole
    texts are used, very long ones in a run of their own; a text of one word is judged by that
    word. Null and repeated ids and repeated rows: every row is judged by itself, equal texts
    alike. Empty table: empty result. keep: names or expressions of further columns of docs to
    carry along; their names have to differ from those above, so pack columns of unknown names
    into a struct. Other columns are left out.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.langs, model.logp))  # TABLE numbers a language
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data"), *keep)
    extra = [f for f in rows.schema if f.name not in ("doc_id", "data")]
    schema = T.StructType([rows.schema["doc_id"], *extra, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("proportions", T.MapType(T.StringType(), T.DoubleType()))])

    def judged(texts: list[bytes | None]) -> tuple[np.ndarray, list[bool]]:
        langs, logp = sent.value
        low = [_lower(t or b"") for t in texts]
        joined = np.concatenate([x for t in low for x in (t, np.array([32], np.uint8))])
        gram, word = _grams(joined)
        pi = np.zeros((len(texts), max(1, len(langs))))
        if len(gram) and langs:
            ll = np.add.reduceat(logp[gram], np.flatnonzero(np.diff(word, prepend=-1)), axis=0)
            inside = joined != 32
            begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
            doc = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), begins, side="right")
            pi = _mixture(np.exp(ll - ll.max(axis=1, keepdims=True)).astype(np.float64), doc, len(texts), penalty)
        return pi, [bool(langs) and bool(_LETTER.search((t or b"").decode("utf-8", "replace"))) for t in texts]

    def run(batches):
        langs = sent.value[0]
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            for i, j in _runs(texts):
                pi, known = judged(texts[i:j])
                best = pi.argmax(axis=1)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), *[part.column(2 + k) for k in range(len(extra))],
                    pa.array([langs[x] if ok else UNKNOWN for x, ok in zip(best, known, strict=True)], pa.string()),
                    pa.array([float(min(1.0, pi[k, x])) if ok else 0.0 for k, (x, ok) in enumerate(zip(best, known, strict=True))], pa.float64()),
                    pa.array([[(langs[x], float(pi[k, x])) for x in np.flatnonzero(pi[k])] if ok else [] for k, ok in enumerate(known)], pa.map_(pa.string(), pa.float64())),
                ], names=schema.names)

    return rows.mapInArrow(run, schema)
