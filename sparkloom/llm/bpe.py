"""BPE encoding and decoding with a contiguous rank array.

A word is held as part boundaries and, beside them, the merge rank of each pair of adjacent
parts. Encoding scans for the smallest rank, deletes the boundary between the two parts and
refreshes the two neighbouring ranks, until no pair has a rank. Words beyond ``SCAN_CHARS``
characters keep the same pairs in a heap over linked boundaries, which gives the same merges
(smallest rank first, then leftmost) without a quadratic scan.

The vocabulary file is one of the ``tokenizers`` library's JSON files with: NFC, white space
to one space, lower case; a split into contractions, letter runs, single digits and symbol runs;
byte-level characters; an end-of-word suffix; no decoder (tokens are joined by a space). Special
tokens found in a raw text become their ids, as in the library.

Cases: a null or empty text, or one of white space alone, has no tokens and decodes to the
empty string. Lone surrogates cannot occur in Spark strings. Repeated rows are encoded alike;
an empty table gives an empty result; columns that clash with the result's are replaced. A
batch holds ``slices`` rows at a time, and the word cache is bounded, so memory
depends on the longest text only.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.llm.common import slices

#: Longest word that is scanned; longer ones use the heap.
SCAN_CHARS = 96
#: Words whose tokens a worker remembers (twice as many at most), and the longest such word.
CACHE_WORDS, CACHE_CHARS = 125_000, 64
#: White space as the tokenizer's regular expressions have it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NEVER = 1 << 60
# Letters, numbers and lower cases that the library knows and Unicode 15.1 does not, as first and last code points.
NEWER_LETTERS = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7
113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"""
NEWER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: First and last code point, and the lower case of the first.
NEWER_CASES = "1C89-1C89-1C8A A7CB-A7CB-264 A7CC-A7CC-A7CD A7CE-A7CE-A7CF A7D2-A7D2-A7D3 A7D4-A7D4-A7D5 A7DA-A7DA-A7DB A7DC-A7DC-19B 10D50-10D65-10D70 16EA0-16EB8-16EBB"
# Combining marks that the library's normal forms do not know (they stay where they are), and the signs of a composition that it does not know, as first and last code points.
NOT_MARKS = """7FD-7FD 898-89F 8CA-8D3 9FE-9FE C3C-C3C D3B-D3C EBA-EBA 1715-1715 1ABF-1ACE 1DF6-1DFA A82C-A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85
11070-11070 1133B-1133B 1145E-1145E 11839-1183A 1193D-1193E 11943-11943 119E0-119E0 11A34-11A34 11A47-11A47 11A99-11A99 11D42-11D42 11D44-11D45 11D97-11D97 11F41-11F42
16FF0-16FF1 1E08F-1E08F 1E130-1E136 1E2AE-1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"""
NOT_COMPOSED = "11930-11930 11935-11935 11938-11938"
#: Stands for a byte that the vocabulary lacks; it merges with nothing and is left out, as in the library.
UNKNOWN = (1 << 20) - 1


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others take code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


def char_class(category: str) -> str:
    """The characters whose Unicode category begins so, as ranges of a character class."""
    own = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == category]
    starts = [c for k, c in enumerate(own) if not k or own[k - 1] != c - 1]
    ends = [c for k, c in enumerate(own) if k + 1 == len(own) or own[k + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


def hexes(values: str) -> list[list[int]]:
    return [[int(x, 16) for x in v.split("-")] for v in values.split()]


def ranges(values: str) -> str:
    """Ranges of code points as part of a character class."""
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in hexes(values))


LOWER = {c: to + c - a for a, b, to in hexes(NEWER_CASES) for c in range(a, b + 1)}


APART = re.compile(f"([{ranges(NOT_MARKS)}{ranges(NOT_COMPOSED)}])")


class WordBpe:
    """An encoder and decoder for one vocabulary file."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("not a plain BPE vocabulary")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks: dict[int, int] = {}  # of a pair of ids
        self.merged: list[int] = []
        for k, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a] << 20 | self.vocab[b]] = k
            self.merged.append(self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens") or []}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.inner = [self.vocab.get(c, UNKNOWN) for c in byte_chars()]
        self.final = [self.vocab.get(c + self.suffix, UNKNOWN) for c in byte_chars()]
        self.complete = UNKNOWN not in self.inner and UNKNOWN not in self.final
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.space = re.compile(f"[{SPACE}]+")
        letter, number = char_class("L") + ranges(NEWER_LETTERS), char_class("N") + ranges(NEWER_NUMBERS)
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+").findall
        # of runs without white space: the latest ones, and those before them
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def normalize(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            # what the library takes for a letter is passed by no mark and composed with none
            text = "".join(unicodedata.normalize("NFC", part) for part in APART.split(text))
        # each character is lowered by itself: a final sigma is like any other
        return self.space.sub(" ", text).replace("Σ", "σ").lower()

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        data = word.encode()
        if not data:
            return []
        parts = [self.inner[b] for b in data[:-1]]
        parts.append(self.final[data[-1]])
        parts = self._scan(parts) if len(parts) <= SCAN_CHARS else self._heap(parts)
        return parts if self.complete else [p for p in parts if p in self.tokens]

    def _scan(self, parts: list[int]) -> list[int]:
        """``parts`` holds, for each boundary, the id of the part that starts there."""
        get, merged = self.ranks.get, self.merged
        ranks = [get(a << 20 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            k = ranks.index(least)
            parts[k] = made = merged[least]
            del parts[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get(made << 20 | parts[k + 1], NEVER)
            if k:
                ranks[k - 1] = get(parts[k - 1] << 20 | made, NEVER)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        get, n = self.ranks.get, len(parts)
        ahead, back = [*range(1, n + 1), n], [-1, *range(n)]  # of each boundary: the next and the previous one
        rank = [NEVER] * (n + 1)
        gone = [False] * (n + 1)
        heap: list[tuple[int, int]] = []

        def refresh(k: int) -> None:
            b = ahead[k]
            rank[k] = get(parts[k] << 20 | parts[b], NEVER) if b < n else NEVER
            if rank[k] != NEVER:
                heapq.heappush(heap, (rank[k], k))

        for k in range(n):
            refresh(k)
        while heap:
            r, k = heapq.heappop(heap)
            if gone[k] or rank[k] != r:
                continue
            b = ahead[k]
            parts[k] = self.merged[r]
            gone[b], ahead[k] = True, ahead[b]
            back[ahead[b]] = k
            refresh(k)
            if back[k] >= 0:
                refresh(back[k])
        return [p for p, out in zip(parts, gone) if not out]

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """Of a run without white space: token count, ids and tokens, each joined by a space."""
        out = self.older.get(chunk) or self._chunk(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.older = dict(self.cache)
                self.cache.clear()  # the same object: callers hold its get
            self.cache[chunk] = out
        return out

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        ids = [i for w in self.split(chunk if chunk.isascii() else chunk.translate(LOWER)) for i in self.word(w)]
        return (len(ids), " ".join(map(str, ids)), " ".join(map(self.tokens.__getitem__, ids)))

    def encode_joined(self, text: str | None) -> tuple[int, str, str]:
        """Token count, ids joined by a space, and the decoded text."""
        if not text:
            return 0, "", ""
        parts = self.split_special.split(text) if self.split_special else [text]
        out: list[tuple[int, str, str]] = []
        get, chunk = self.cache.get, self.chunk
        for k, part in enumerate(parts):
            if k % 2:
                out.append((1, str(self.special[part]), part))
            elif part:
                out += [get(w) or chunk(w) for w in self.normalize(part).split(" ") if w]
        if not out:
            return 0, "", ""
        n, ids, tokens = zip(*out)
        if 0 in n:  # words of which the vocabulary has no part
            ids, tokens = filter(None, ids), filter(None, tokens)
        return sum(n), " ".join(ids), " ".join(tokens)

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, self.encode_joined(text)[1].split()))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def _coder(spec_of: Callable[[], str]) -> WordBpe:
    """One coder for each worker process and vocabulary."""
    spec = spec_of()
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = WordBpe(spec)
    return _CODERS[key]


_CODERS: dict[str, WordBpe] = {}


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file's text, read once by the driver and sent to the executors (a fixed file of a few MB)."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ids (array of int) in place of its text column."""
    spec = _vocabulary(df, path)
    rest = df.select(*[c for c in df.columns if c != "ids"])
    schema = T.StructType([*[f for f in rest.schema if f.name != text], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(lambda: spec.value)
        for b in slices(batches):
            ids = pa.array([coder.encode(t) for t in b.column(text).to_pylist()], pa.list_(pa.int32()))
            kept = [n for n in b.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], ids], names=[*kept, "ids"])

    return rest.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with the decoded text in place of its ids."""
    spec = _vocabulary(df, path)
    rest = df.select(*[c for c in df.columns if c != "text"])
    schema = T.StructType([*[f for f in rest.schema if f.name != ids], T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(lambda: spec.value)
        for b in slices(batches):
            texts = pa.array([coder.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())
            kept = [n for n in b.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], texts], names=[*kept, "text"])

    return rest.mapInArrow(run, schema)


def digests(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded and decoded in one pass."""
    spec = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(lambda: spec.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in slices(batches):
            rows = [(n, sha(ids), sha(back)) for n, ids, back in map(coder.encode_joined, b.column("text").to_pylist())]
            n, ids, back = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
