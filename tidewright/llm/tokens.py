"""Tokenizers inside tasks: one instance a Python worker, and a bounded table of words seen.

Texts are cut only where no token can span the cut, so the parts' tokens are the whole's. Which
cuts are safe follows from the tokenizer's own settings, never from its file name; a tokenizer
of another kind gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words a worker's table holds before it starts anew from those of its last batch; bounds memory only, not what is encoded.
REMEMBERED = 1_000_000
#: Characters of a long text that are encoded at once.
PART = 1 << 16
#: Bytes of text in a batch handed to the encoder.
BATCH_BYTES = 4 << 20
#: Words that are learnt in one call.
LEARN = 256
#: Bytes of the longest piece whose count is remembered; longer ones are encoded each time.
LONGEST = 64
_CUT = re.compile(r"[!-~](?=[ \n])")
_BLANK = re.compile(r"[!-~](?= )")
#: Alternatives of a pre-tokenizer's pattern that match no white space.
_BLANKLESS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}
_PLAIN_NORMALIZERS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})

#: ASCII letters 1, digits 2, signs 3; 0 for all else and for the apostrophe, which may belong to what follows.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 0

_loaded: dict[str, object] = {}
_styles: dict[str, str] = {}
_words: dict[tuple[str, str], Words] = {}
_counts: dict[str, Counts] = {}


def load(path: str):
    """The library's own encoder for a file: tokenizers for .json, sentencepiece for .model."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _loaded[path] = t
    return _loaded[path]


def vocab_size(path: str) -> int:
    t = load(path)
    return t.get_piece_size() if path.endswith(".model") else t.get_vocab_size()


def style_of(path: str) -> str:
    """Where a text may be cut, by the tokenizer's own settings.

    ``drops``: white space makes no token, so texts fall into words at every blank. ``leads``:
    white space goes with what follows it (byte-level pattern), so a cut may precede it.
    ``pieces``: no piece holds a blank after another character and a blank is put before each
    text, so a single blank may be left out. ``whole``: nothing is known; texts stay whole.
    """
    if path not in _styles:
        _styles[path] = _piece_style(load(path)) if path.endswith(".model") else _json_style(json.loads(load(path).to_str()))
    return _styles[path]


def _piece_style(t) -> str:
    pieces = (t.id_to_piece(i) for i in range(t.get_piece_size()))
    inner = any("▁" in p.lstrip("▁") for p in pieces)
    same = all(t.encode(a + " " + b) == t.encode(a) + t.encode(b) for a, b in (("a", "b"), ("a", " b"), ("a.", "  b "), ("a,", "\nb")))
    return "pieces" if same and not inner else "whole"


def _json_style(t: dict) -> str:
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] or any(c.isspace() for c in a["content"]) for a in t["added_tokens"]):
        return "whole"
    normal, pre = t["normalizer"] or {}, t["pre_tokenizer"] or {}
    if not normal and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return "leads"
    plain = all(n in _PLAIN_NORMALIZERS for n in (normal.get("normalizers", [normal]) if normal else []))
    first = (pre.get("pretokenizers") or [pre])[0]
    words = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and set(first["pattern"].get("Regex", "").split("|")) <= _BLANKLESS
    return "drops" if plain and words else "whole"


def encode(path: str, texts: list[str]) -> list[list[int]]:
    """Token ids of texts as the library gives them, nothing added."""
    t = load(path)
    if path.endswith(".model"):
        return t.encode(texts, num_threads=1)
    return [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def _lengths(path: str, texts: list[str]) -> list[int]:
    t = load(path)
    if path.endswith(".model"):
        return [len(x) for x in t.encode(texts, num_threads=1)]
    return [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def by_bytes(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_BYTES each, so that batches take alike long and memory is bounded."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= BATCH_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def parts(text: str, style: str) -> list[str]:
    """A long text cut at safe boundaries: before white space that follows a visible ASCII character."""
    if style == "whole":
        return [text]
    cut, skip = (_BLANK, 1) if style == "pieces" else (_CUT, 0)
    out, at = [], 0
    while len(text) - at > PART and (m := cut.search(text, at + PART)):
        out.append(text[at : m.end()])
        at = m.end() + skip
    return [*out, text[at:]]


def _batches(path: str, raw: list[bytes | None]):
    """(owner, part) lists of about BATCH_BYTES each; a long text may lie in several."""
    style, owner, found, size = style_of(path), [], [], 0
    for i, d in enumerate(raw):
        cut = parts((d or b"").decode("utf-8", "replace"), style)
        for p in cut:
            owner.append(i)
            found.append(p)
            size += len(d or b"") if len(cut) == 1 else len(p.encode())
            if size >= BATCH_BYTES:
                yield owner, found
                owner, found, size = [], [], 0
    if owner:
        yield owner, found


def lengths(path: str, raw: list[bytes | None]) -> np.ndarray:
    """Tokens of each text (UTF-8); only lengths leave the library."""
    out = np.zeros(len(raw), np.int64)
    if style_of(path) == "leads" and path not in _counts:
        _counts[path] = Counts(path)
    for owner, found in _batches(path, raw):
        np.add.at(out, owner, _counts[path].lengths(found) if path in _counts else _lengths(path, found))
    return out


def ids(path: str, raw: list[bytes | None], kind: str) -> Iterator[bytes]:
    """Token ids of each text as bytes of numpy type kind, in order."""
    if style_of(path) == "drops":
        if (path, kind) not in _words:
            _words[path, kind] = Words(path, kind)
        for lo, hi in by_bytes(raw):
            yield from _words[path, kind].encode([d or b"" for d in raw[lo:hi]])
        return
    held, at = [], 0
    for owner, found in _batches(path, raw):
        for i, x in zip(owner, encode(path, found), strict=True):
            if i != at:
                yield b"".join(held)
                held, at = [], i
            held.append(np.array(x, kind).tobytes())
    if raw:
        yield b"".join(held)


class Words:
    """A table of words and their ids for a tokenizer that drops white space.

    A batch becomes one buffer of words. Arrow encodes them as a dictionary, so Python sees each
    distinct word of a batch once, and ids are gathered from the table by position. ASCII runs of
    letters, digits and signs are words of their own, as they are tokens of their own in the
    pre-tokenizer, and A-Z are lowered where the tokenizer does so anyway; in a batch in which a
    special token's string may stand, texts are cut at blanks only. New words of a-z go to the
    library's model directly; others are encoded together, blanks between them, and the
    library's offsets tell whose each id is.
    """

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind
        self.lower = "Lowercase" in str(load(path).normalizer)
        self.special = [t.content.lower()[:2].encode() for t in load(path).get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat, self.starts, self.lens = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        t = load(self.path)
        plain = [w for w in words if w.isalpha() and w.islower()]
        tokens = [[x.id for x in t.model.tokenize(w.decode())] for w in plain]
        found, counts = [self.flat, np.array([i for x in tokens for i in x], self.kind)], [self.lens, np.array([len(x) for x in tokens], np.int64)]
        rest = [w for w in words if not (w.isalpha() and w.islower())]
        for lo in range(0, len(rest), LEARN):
            texts = [w.decode("utf-8", "replace") for w in rest[lo : lo + LEARN]]
            e = t.encode(" ".join(texts), add_special_tokens=False)
            begins = np.cumsum([0] + [len(x) + 1 for x in texts])
            place = np.searchsorted(begins, np.array([a for a, _ in e.offsets], np.int64), side="right") - 1
            found.append(np.array(e.ids, self.kind))
            counts.append(np.bincount(place, minlength=len(texts)))
        self.at.update((w, len(self.at)) for w in (*plain, *rest))
        self.flat, self.lens = np.concatenate(found), np.concatenate(counts)
        self.starts = np.cumsum(self.lens) - self.lens

    def _cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all words, place of each word's first byte, words up to each text's end)."""
        joined = b" ".join(texts) + b" "
        data = np.frombuffer(joined, np.uint8)
        blank = (data == 32) | (data == 10)
        first = ~blank
        first[1:] &= blank[:-1]
        low = joined.lower()
        if not any(s in low for s in self.special):
            if self.lower:
                data = np.frombuffer(low, np.uint8)  # bytes.lower changes A-Z alone
            kind = _KIND[data]
            first[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        ends = np.cumsum([len(t) + 1 for t in texts])
        return data[~blank], np.flatnonzero(first[~blank]), np.searchsorted(np.flatnonzero(first), ends)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        data, firsts, upto = self._cut(texts)
        offsets = np.append(firsts, len(data))
        words = pa.Array.from_buffers(pa.large_binary(), len(firsts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.at) > REMEMBERED:
            self._reset()
        self._learn([w for w in distinct if w not in self.at])
        word = np.fromiter(map(self.at.__getitem__, distinct), np.int64, len(distinct))[np.asarray(words.indices)]
        lens = self.lens[word]
        tokens = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])
        out = self.flat[np.arange(tokens[-1]) + np.repeat(self.starts[word] - tokens[:-1], lens)]
        ends = tokens[upto].tolist()
        for i, j in zip([0, *ends[:-1]], ends, strict=True):
            yield out[i:j].tobytes()


class Counts:
    """A table of pieces and their numbers of tokens for a byte-level tokenizer, whose white space goes with what follows it.

    A piece ends before a space or line feed that follows a visible ASCII character or a letter
    of U+00C0 to U+017F, and between ASCII runs of letters, digits and signs; the pattern has no
    token across these places and looks no further back. The apostrophe isn't cut from its
    neighbours. Where a special token's string stands in a batch, its texts are cut at blanks
    only. Arrow encodes a batch's pieces as a dictionary, so the library's batch encoder gets
    each distinct piece of a batch once, and not again while the table holds it.
    """

    def __init__(self, path: str):
        self.path = path
        self.special = [t.content.encode() for t in load(path).get_added_tokens_decoder().values()]
        self.at: dict[bytes, int] = {}

    def _firsts(self, joined: bytes) -> np.ndarray:
        """Whether a piece begins at each byte, apart from texts' own begins."""
        data = np.frombuffer(joined, np.uint8)
        first = (data == 32) | (data == 10)
        ends = (data > 32) & (data < 127)
        ends[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xC5) & (data[1:] >= 0x80)
        first[1:] &= ends[:-1]
        if not any(s in joined for s in self.special):
            kind = _KIND[data]
            first[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        return first

    def lengths(self, texts: list[str]) -> np.ndarray:
        raw = [t.encode() for t in texts]
        joined, ends = b"".join(raw), np.cumsum([len(t) for t in raw])
        if not joined:
            return np.zeros(len(raw), np.int64)
        first = self._firsts(joined)
        begins = ends - [len(t) for t in raw]
        first[begins[begins < len(joined)]] = True
        starts = np.flatnonzero(first)
        offsets = np.append(starts, len(joined))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.at) > REMEMBERED:
            self.at = {}
        new = [w for w in distinct if w not in self.at]
        learnt = dict(zip(new, _lengths(self.path, [w.decode() for w in new]), strict=True))
        counts = np.array([learnt[w] if w in learnt else self.at[w] for w in distinct], np.int64)
        self.at.update((w, n) for w, n in learnt.items() if len(w) <= LONGEST)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts[np.asarray(pieces.indices)])])[np.searchsorted(starts, ends)]
        return np.diff(upto, prepend=0)
