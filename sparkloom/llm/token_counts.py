"""Token counts by rank-synchronous merging of ragged arrays.

Texts are split into pre-tokens as byte-level vocabularies do (contractions, letters, digits and symbols with
an optional leading space, white space). The pre-tokens of a batch that are not known yet stand in one ragged array, a symbol per byte, with a
start per pre-token. Each round looks up the merge rank of all adjacent pairs of symbols, takes the lowest of each pre-token (``minimum.reduceat``),
merges that pair wherever it stands in its pre-token, and drops the merged symbols; pre-tokens without a pair left are done. The symbols that
survive are counted; a text has the sum over its pre-tokens.

Where a pair stands several times in a pre-token, all its places are merged in one round (of overlapping ones every second from the left). This is what merging one
by one gives as long as every symbol is made by one merge only, whose rank is then lower than that of any pair with it. In other vocabularies only the leftmost place is merged.

The vocabulary file is one of the ``tokenizers`` library's JSON files with byte-level characters and no normalizer. Special tokens found in a
text are one token each, as is the library's default.

Cases: a null or empty text has no bytes and no tokens; white space counts like other text. Bytes that the vocabulary
lacks count nothing. Repeated rows are counted alike; an empty table gives an empty result; columns that clash with
the result's are replaced. Counts of pre-tokens are kept in a bounded memory; a long text is read ``AT_ONCE`` pre-tokens at a time, and a pre-token of any length is merged in array rounds,
so memory depends on the longest text only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.llm.bpe import NEWER_LETTERS, NEWER_NUMBERS, SPACE, byte_chars, char_class, ranges
from sparkloom.llm.common import slices

#: Tokens of a text from which on it is over the limit.
LIMIT = 512
#: Pre-tokens whose counts a worker remembers (twice as many at most), and the longest such one.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
#: Pre-tokens of a long text that are read together, characters from which a text is long, and bytes of new pre-tokens that are merged together.
AT_ONCE, LONG, BATCH_BYTES = 1 << 16, 1 << 20, 1 << 20
NEVER = np.int64(1) << 40
#: Stands for a byte that the vocabulary lacks.
UNKNOWN = (1 << 20) - 1


def pattern(letter: str, number: str, space: str) -> re.Pattern:
    """Pre-tokens of a text, given the characters of three classes."""
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Counter:
    """Counts the tokens of texts for one vocabulary file."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        options = ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in options) or d.get("normalizer") or d["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level vocabulary")
        vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array(c, np.int64).reshape(-1) for c in ([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs]))
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = np.append(keys[order], np.int64(1) << 62), np.append(order, NEVER), made
        by = {int(m): k for k, m in enumerate(made)}
        first = [max(by.get(int(a), -1), by.get(int(b), -1)) for a, b in zip(left, right, strict=True)]
        #: Whether all places of a pair can be merged in one round.
        self.ordered = len(by) == len(made) and all(k > f for k, f in enumerate(first))
        self.symbol = np.array([vocab.get(c, UNKNOWN) for c in byte_chars()], np.int64)
        special = sorted((t["content"] for t in d.get("added_tokens") or []), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        letter, number = char_class("L") + ranges(NEWER_LETTERS), char_class("N") + ranges(NEWER_NUMBERS)
        low = lambda c: "".join(f"{a}-{min(b, chr(0xFFFF))}" for a, b in re.findall("(.)-(.)", c, re.S) if a <= chr(0xFFFF))
        # classes without what a text cannot hold are searched faster
        self.ascii = pattern("A-Za-z", "0-9", "\\t-\\r ")
        self.plane = pattern(low(letter), low(number), SPACE)
        self.every = pattern(letter, number, SPACE)
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text without special tokens, in lists."""
        p = self.ascii if text.isascii() else self.plane if len(text.encode("utf-16-le")) == 2 * len(text) else self.every
        if len(text) < LONG:
            yield p.findall(text)
        else:
            found = (m[0] for m in p.finditer(text))
            while part := list(islice(found, AT_ONCE)):
                yield part

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text."""
        out = [0] * len(texts)
        waiting: list[tuple[int, list[str]]] = []  # texts and pre-tokens that are still to be summed
        size = 0
        for k, text in enumerate(texts):
            parts = self.special.split(text) if text and self.special else [text or ""]
            out[k] += len(parts) // 2
            for part in parts[::2]:
                for piece in self.pieces(part) if part else ():
                    waiting.append((k, piece))
                    size += len(piece)
                    if size >= AT_ONCE:
                        self._sum(waiting, out)
                        waiting, size = [], 0
        self._sum(waiting, out)
        return out

    def _sum(self, waiting: list[tuple[int, list[str]]], out: list[int]) -> None:
        if len(self.cache) >= CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        cache, older, long = self.cache, self.older, {}
        new: dict[str, None] = {}
        for _, piece in waiting:
            for w in set(piece).difference(cache):
                n = older.get(w)
                if n is None:
                    new[w] = None
                else:
                    cache[w] = n
        for group in together(list(new)):
            for w, n in zip(group, self.merged([w.encode() for w in group]), strict=True):
                (cache if len(w) <= CACHE_CHARS else long)[w] = n
        get = (cache | long).__getitem__ if long else cache.__getitem__
        for k, piece in waiting:
            out[k] += sum(map(get, piece))

    def merged(self, words: list[bytes]) -> list[int]:
        """The number of symbols that are left of each pre-token."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), sizes)
        known = symbols != UNKNOWN
        if not known.all():  # the library leaves such bytes out of a pre-token before it merges
            symbols, of = symbols[known], of[known]
        out = np.bincount(of, minlength=len(words))
        while len(symbols) > 1:
            key = symbols[:-1] << 20 | symbols[1:]
            at = np.searchsorted(self.keys, key)
            rank = np.append(np.where((self.keys[at] == key) & (of[:-1] == of[1:]), self.ranks[at], NEVER), NEVER)
            start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            length = np.diff(np.append(start, len(of)))
            least = np.minimum.reduceat(rank, start)
            hit = (rank == np.repeat(least, length)) & (rank != NEVER)
            place = np.flatnonzero(hit)
            if not self.ordered:
                place = place[np.append(True, of[place][1:] != of[place][:-1])] if len(place) else place
            elif len(place):
                # of places that overlap, every second of each chain
                chain = np.append(True, np.diff(place) != 1)
                head = np.flatnonzero(chain)
                nth = np.arange(len(place)) - np.repeat(head, np.diff(np.append(head, len(place))))
                place = place[nth % 2 == 0]
            symbols[place] = self.made[rank[place]]
            keep = np.repeat(least != NEVER, length)  # pre-tokens without a pair are done
            keep[place + 1] = False
            out -= np.bincount(of[place + 1], minlength=len(words))
            symbols, of = symbols[keep], of[keep]
        return out.tolist()


def together(words: list[str]) -> Iterator[list[str]]:
    """Pre-tokens in groups of so many bytes, or one."""
    group, size = [], 0
    for w in words:
        if group and size + len(w) > BATCH_BYTES:
            yield group
            group, size = [], 0
        group.append(w)
        size += len(w)
    if group:
        yield group


def _counter(spec_of: Callable[[], str]) -> Counter:
    """One counter for each worker process and vocabulary."""
    spec = spec_of()
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(spec)
    return _COUNTERS[key]


_COUNTERS: dict[str, Counter] = {}
ADDED = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}


def count(df: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (more tokens than the limit) in place of its text column."""
    with open(path, encoding="utf-8") as f:  # a fixed file of a few MB
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    rest = df.drop(*[c for c in df.columns if c.lower() in ADDED and c != text])
    kept = [f for f in rest.schema.fields if f.name != text]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in ADDED.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(lambda: spec.value)
        for b in slices(batches):
            texts = b.column(text).to_pylist()
            tokens = np.array(counter.counts(texts), np.int64)
            n_bytes = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], n_bytes, pa.array(tokens), pa.array(tokens > limit)], names=[*names, *ADDED])

    return rest.mapInArrow(run, schema)
