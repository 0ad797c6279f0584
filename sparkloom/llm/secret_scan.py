"""Secret scan: three base patterns and a linear-chain conditional random field.

The field tags every word (run of non-white-space) as outside, begin or inside of a secret. A
word's scores are sums of weights of hashed features: of the word itself (shape, character classes,
entropy, known prefixes, keywords), of its neighbours, and of the file (how many of its
words hold digits, or an assignment sign). Viterbi decodes the best tag sequence of the whole text.
A text in which every word's margin for outside exceeds any gain from transitions is all
outside, so only texts with some doubtful word are decoded step by step.

The field is trained on the driver, once per process, on lines this module makes from a fixed
seed (planted secrets and look-alikes among made-up words); it reads no corpus.

Spans are (kind, start, end) in code points, end exclusive. Base kinds, leftmost and
non-overlapping within a kind: assign (keyword, separator, value of 6 or more characters), access
(AKIA and capitals or digits, 20 or more in all), hex (24 or more of 0-9a-f). Kind crf holds
the field's runs without surrounding punctuation; of a run that base spans overlap, the pieces outside of them.

Cases: a null or empty text has no spans. Ties in decoding prefer outside, then begin. Copies get
equal spans; an empty table gives an empty result; columns that clash with ``spans`` are replaced. Memory is bounded by
the longest text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.llm.common import slices

Span = tuple[str, int, int]
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # longest runs: the same as all runs without the short ones
OUT, BEGIN, INSIDE = 0, 1, 2
DIM = 1 << 12
CACHE_WORDS = 100_000
#: Words before a secret, and beginnings of issued keys.
KEYWORDS = "password passwd pwd passphrase secret token api_key apikey key auth authorization bearer credential credentials private".split()
PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- xoxb- xoxp- sk- pk- sk_live_ sk_test_ eyJ AIza SG. ya29. npm_ hf_".split()


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def shape(word: str) -> str:
    """Letters and digits by class, runs collapsed."""
    kinds = "".join("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c if c.isascii() else "u" for c in word[:64])
    return re.sub(r"(.)\1+", r"\1", kinds)[:12]


def core(word: str) -> str:
    return word.strip("\"'`()[]{}<>,;:!?.$%&*#|")


def kind_of(word: str) -> str | tuple:
    """What a word's features depend on: for a plain word (letters within punctuation, no keyword) its
    case, length, script and last character, for any other the word itself."""
    own = core(word)
    if own.isalpha() and not KEYWORD.search(word.lower()):
        n = len(own)
        return (min(n, 8 + 8 * min(4, (n - 8) // 8)), own.islower(), own.isupper(), own.isascii(), word[-1] if word[-1] in ":=" else "")
    return word


@lru_cache(maxsize=4096)
def plain_features(n: int, lower: bool, upper: bool, ascii_only: bool, last: str) -> tuple[int, ...]:
    flags = ["bias", f"plain:{n}", f"case:{lower}:{upper}", f"plain-script:{ascii_only}:{min(n, 16)}", f"ends:{last}"]
    return tuple(zlib.crc32(f.encode()) % DIM for f in flags)


@lru_cache(maxsize=20_000)
def features(kind: str | tuple) -> tuple[int, ...]:
    """Hashed features of a word by itself."""
    if isinstance(kind, tuple):
        return plain_features(*kind)
    word = kind
    own, low = core(word), word.lower()
    value = own.rsplit("=", 1)[-1] if "=" in own.rstrip("=") else own
    n, digits = len(value), sum(c.isdigit() for c in value)
    uppers, lowers = sum(c.isupper() for c in value), sum(c.islower() for c in value)
    share = [value.count(c) / n for c in set(value)] if n else []
    entropy = -sum(p * math.log2(p) for p in share)
    mixed = bool(digits and (uppers or lowers))
    flags = [
        "bias",
        f"length:{min(n, 7) if n < 8 else 8 + min(4, (n - 8) // 8)}",
        f"shape:{shape(value)}" if n < 24 else "shape:long",
        f"classes:{digits > 0}{uppers > 0}{lowers > 0}{any(c in '+/_=-.' for c in value)}",
        f"mixed:{mixed}:{min(4, n // 8)}",
        f"turns:{mixed}:{min(8, len(re.findall('[0-9]+', value)))}",
        f"entropy:{int(entropy * 2)}:{mixed}",
        f"hex:{bool(re.fullmatch('[0-9a-fA-F]+', value)) and mixed and n >= 16}",
        f"ends:{word[-1:] if word[-1:] in ':=' else ''}",
        f"assigns:{'=' in word.rstrip('=') or ':' in word.rstrip(':')}:{mixed}",
        f"upper-only:{uppers > 0 and not lowers}:{digits > 0}",
        f"non-ascii:{not value.isascii()}",
        f"address:{'@' in value[1:] and '.' in value.rpartition('@')[2]}:{'://' in value}",
    ]
    flags += [f"keyword:{k}" for k in KEYWORDS if core(low).rstrip("=:") == k] + (["has-keyword"] if any(k in low for k in KEYWORDS[:8]) else [])
    flags += ["prefix"] if value.startswith(tuple(PREFIXES)) and n >= 16 else []
    return tuple(zlib.crc32(f.encode()) % DIM for f in flags)


def file_features(n: int, digits: int, assigns: int) -> tuple[int, ...]:
    """Of a file with so many words, words with digits and words with an assignment sign."""
    flags = (f"file-digits:{int(10 * digits / n)}", f"file-assigns:{min(5, int(20 * assigns / n))}")
    return tuple(zlib.crc32(f.encode()) % DIM for f in flags)


DIGIT = re.compile(r"[0-9]")
KEYWORD = re.compile("|".join(KEYWORDS))


class Field:
    """The trained field. weights: role (word, previous, one before, next), feature, tag."""

    def __init__(self):
        self.weights = np.zeros((4, DIM, 3))
        self.file = np.zeros((DIM, 3))
        self.moves = np.zeros((3, 3))
        self._ready()

    def _ready(self) -> None:
        self.cache: dict[str, int] = {}  # of words
        self.rows: dict[str | tuple, int] = {}  # of what their scores depend on
        self.table = np.zeros((1024, 4, 3))
        self.marks = np.zeros((1024, 2), bool)

    def __getstate__(self):
        return {"weights": self.weights, "file": self.file, "moves": self.moves}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _id(self, word: str) -> int:
        if len(self.cache) >= CACHE_WORDS:
            self._ready()
            return -1
        kind = kind_of(word)
        mark = (bool(DIGIT.search(word)), "=" in word or ":" in word)
        row = kind if isinstance(kind, str) else (kind, mark)
        if (k := self.rows.get(row)) is None:
            k = self.rows[row] = len(self.rows)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.marks = np.concatenate([self.marks, np.zeros_like(self.marks)])
            self.table[k] = self.weights[:, list(features(kind))].sum(axis=1)
            self.marks[k] = mark
        self.cache[word] = k
        return k

    def scores(self, words: list[str]) -> np.ndarray:
        """Of each word and tag."""
        while True:
            get = self.cache.get
            ids = [k if (k := get(w)) is not None else self._id(w) for w in words]
            if -1 not in ids:
                break
            if len(set(words)) > CACHE_WORDS // 2:  # a text with more kinds of words than are cached
                rows = np.stack([self.weights[:, list(features(kind_of(w)))].sum(axis=1) for w in words])
                marks = np.array([(bool(DIGIT.search(w)), "=" in w or ":" in w) for w in words])
                return self._sum(rows, marks)
        at = np.array(ids)
        return self._sum(self.table[at], self.marks[at])

    def _sum(self, rows: np.ndarray, marks: np.ndarray) -> np.ndarray:
        e = rows[:, 0].copy()
        e[1:] += rows[:-1, 1]
        e[2:] += rows[:-2, 2]
        e[:-1] += rows[1:, 3]
        return e + self.file[list(file_features(len(rows), *marks.sum(axis=0)))].sum(axis=0)

    def gain(self) -> float:
        """The most that transitions add for each word of a run that is not outside."""
        m = self.moves
        ends = m[OUT, BEGIN] + max(m[BEGIN, OUT], m[INSIDE, OUT]) - 2 * m[OUT, OUT]
        # the text's borders count as outside words
        return max(0.0, ends, m[1:, 1:].max() - m[OUT, OUT])

    def decode(self, e: np.ndarray) -> list[int]:
        """Viterbi over the scores of a text."""
        if not len(e) or (e[:, OUT] - e[:, 1:].max(axis=1)).min() > self.gain():
            return [OUT] * len(e)
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.moves.tolist()
        back = []
        o, b, i = 0.0, -math.inf, -math.inf  # before the text: outside
        for eo, eb, ei in e.tolist():
            from_o = max((o + oo, 2), (b + bo, 1), (i + io, 0))
            from_b = max((o + ob, 2), (b + bb, 1), (i + ib, 0))
            from_i = max((b + bi, 1), (i + ii, 0))
            back.append((2 - from_o[1], 2 - from_b[1], 2 - from_i[1]))
            o, b, i = from_o[0] + eo, from_b[0] + eb, from_i[0] + ei
        tag = max((o + oo, 2), (b + bo, 1), (i + io, 0))[1]
        tags = [2 - tag]
        for step in reversed(back[1:]):
            tags.append(step[tags[-1]])
        return tags[::-1]

    def spans(self, text: str) -> list[Span]:
        words = text.split()
        if not words:
            return []
        tags = self.decode(self.scores(words))
        if not any(tags):
            return []
        found: list[Span] = []
        run: tuple[int, int] | None = None
        for m, tag in zip(re.finditer(r"\S+", text), tags, strict=True):
            if tag == INSIDE and run:
                run = (run[0], m.end())
                continue
            if run:
                found.append(("crf", *run))
            run = (m.start(), m.end()) if tag else None
        if run:
            found.append(("crf", *run))
        out = []
        for _, a, b in found:
            inner = core(text[a:b])
            if inner:
                at = text.index(inner, a)
                out.append(("crf", at, at + len(inner)))
        return out


def made_lines(n: int, seed: int = 20) -> list[tuple[list[str], list[int]]]:
    """Lines of words with their tags: planted secrets, look-alikes and plain words."""
    rnd = random.Random(seed)
    bits = "an ar be ca de el en er es ge ha in is la le lo ma me mi na ne no on or pa ra re ri sa se si ta te ti to un ver ción é ü ß ñ".split()
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def some(chars: str, a: int, b: int) -> str:
        return "".join(rnd.choices(chars, k=rnd.randint(a, b)))

    def word() -> str:
        w = "".join(rnd.choices(bits, k=rnd.randint(1, rnd.choice([3, 6, 16]))))
        w = rnd.choice([w] * 6 + [w.upper(), w.capitalize()])
        return w + rnd.choice([""] * 14 + [",", ".", "!!", "$$$", "###", "%%%", "&&&", "***", ":", ";", "?"])

    def alike() -> str:
        return rnd.choice(
            [
                lambda: some(num, 1, 16),
                lambda: ".".join(some(num, 1, 3) for _ in range(4)),
                lambda: f"{word()}@{some(low, 4, 9)}.com",
                lambda: f"{some(low, 3, 12)}.{some(num, 1, 4)}@{some(low, 4, 9)}{some(num, 0, 2)}.{some(low, 4, 9)}.{rnd.choice(['com', 'org', 'net'])}",
                lambda: f"https://{some(low, 4, 9)}.com/{some(low, 2, 8)}/{some(num, 1, 5)}?{some(low, 2, 5)}={some(low + num, 2, 6)}",
                lambda: f"{some(num, 4, 4)}-{some(num, 2, 2)}-{some(num, 2, 2)}",
                lambda: f"+{some(num, 2, 2)}-{some(num, 3, 3)}-{some(num, 6, 7)}",
                lambda: f"{some(num, 3, 3)}-{some(num, 2, 2)}-{some(num, 4, 4)}",
                lambda: f"v{some(num, 1, 2)}.{some(num, 1, 2)}.{some(num, 1, 2)}",
                lambda: f"{rnd.choice(['item', 'doc', 'page', 'src', 'user'])}{some(num, 1, 6)}",
                lambda: f"{some(low, 3, 9)}={rnd.choice([some(num, 1, 4), 'true', 'false', some(low, 3, 8)])}",
                lambda: some(up, 3, 12) + "!!",
                lambda: f"({some(num, 1, 4)})",
                lambda: "|",
            ]
        )()

    def secret() -> str:
        return rnd.choice(
            [
                lambda: some("0123456789abcdef", 24, 64),
                lambda: "AKIA" + some(up + num, 16, 16),
                lambda: rnd.choice(PREFIXES) + some(low + up + num, 20, 40),
                lambda: some(low + up + num, 15, 42) + some(num, 1, 2),
                lambda: some(low + up + num + "+/", 27, 60) + rnd.choice(["", "=", "=="]),
            ]
        )()

    def password() -> str:
        return some(low + up + num + "!@#%^&*-_", 7, 18) + some(num, 1, 2) if rnd.random() < 0.7 else some(low, 3, 8) + some(num, 2, 4) + rnd.choice(["!", "#", "", "?"])

    lines = []
    for _ in range(n):
        words, tags = [], []

        def add(w: str, tag: int = OUT, words=words, tags=tags) -> None:
            words.append(w)
            tags.append(tag)

        for _ in range(rnd.randint(1, 14)):
            add(alike() if rnd.random() < 0.15 else word())
        kind, key = rnd.random(), rnd.choice(KEYWORDS)
        key = rnd.choice([key, key.upper(), key.capitalize()])
        quote = rnd.choice(['"', "'", "", ""])
        if kind < 0.2:
            add(key), add(rnd.choice(["=", ":", "is", "->"])), add(quote + secret() + quote, BEGIN)
        elif kind < 0.3:
            add(key + ":"), add(quote + rnd.choice([secret, password])() + quote, BEGIN)
        elif kind < 0.4:
            add(key + "=" + quote + rnd.choice([secret, password])() + quote, BEGIN)
        elif kind < 0.5:
            add(rnd.choice(["password", "passwd", "pwd", "Password"])), add(rnd.choice(["is", "=", ":"])), add(password(), BEGIN)
        elif kind < 0.6:
            add(secret() + rnd.choice(["", "", ",", "."]), BEGIN)
        elif kind < 0.65:
            add("-----BEGIN"), add("PRIVATE"), add("KEY-----")
            for k in range(rnd.randint(2, 4)):
                add(some(low + up + num + "+/", 40, 64), BEGIN if not k else INSIDE)
            add("-----END"), add("PRIVATE"), add("KEY-----")
        elif kind < 0.75:  # a keyword in plain words
            add(key), add(rnd.choice(["is", "of", "was", ":", "="]) if rnd.random() < 0.7 else word()), add(word())
        for _ in range(rnd.randint(1, 14)):
            add(alike() if rnd.random() < 0.15 else word())
        lines.append((words, tags))
    return lines


def fit(lines: list[tuple[list[str], list[int]]], steps: int = 120, l2: float = 0.02) -> Field:
    """Maximum likelihood by full-batch AdaGrad; sequences of all lengths run side by side."""
    n, length, most = len(lines), max(len(w) for w, _ in lines), max(len(features(kind_of(w))) for ws, _ in lines for w in ws)
    role_feats = np.full((n, length + 3, most), DIM, np.int64)  # two empty words before, one after; DIM: none
    tags = np.zeros((n, length), np.int64)
    mask = np.zeros((n, length), bool)
    files = np.zeros((n, 2), np.int64)
    for i, (words, tg) in enumerate(lines):
        for t, w in enumerate(words):
            f = features(kind_of(w))
            role_feats[i, t + 2, : len(f)] = f
        tags[i, : len(tg)] = tg
        mask[i, : len(tg)] = True
        files[i] = file_features(len(words), sum(bool(DIGIT.search(w)) for w in words), sum("=" in w or ":" in w for w in words))
    shifts = (2, 1, 0, 3)  # of the roles word, previous, one before, next
    params = [np.zeros((4, DIM + 1, 3)), np.zeros((DIM, 3)), np.zeros((3, 3))]
    barred = np.zeros((3, 3))
    barred[OUT, INSIDE] = -1e4
    seen = [np.full(p.shape, 1e-8) for p in params]
    gold = np.eye(3)[tags] * mask[:, :, None]
    feats = [role_feats[:, s : s + length] for s in shifts]
    for _ in range(steps):
        w, f, m = params
        moves = m + barred
        e = sum(w[r][feats[r]].sum(axis=2) for r in range(4)) + f[files].sum(axis=1)[:, None, :]
        alpha = np.zeros((n, length, 3))
        alpha[:, 0] = moves[OUT] + e[:, 0]
        for t in range(1, length):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves[None], axis=1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        total = np.logaddexp.reduce(alpha[:, -1] + moves[:, OUT], axis=1)
        beta = np.zeros((n, length, 3))
        beta[:, -1] = moves[:, OUT]
        grad_m = np.zeros((3, 3))
        for t in range(length - 1, 0, -1):
            inner = moves[None] + (e[:, t] + beta[:, t])[:, None, :]
            pair = np.exp(np.minimum(0, alpha[:, t - 1, :, None] + inner - total[:, None, None])) * mask[:, t, None, None]
            grad_m -= pair.sum(axis=0)
            beta[:, t - 1] = np.where(mask[:, t, None], np.logaddexp.reduce(inner, axis=2), beta[:, t])
        p = np.exp(np.minimum(0, alpha + beta - total[:, None, None])) * mask[:, :, None]
        last = mask.sum(axis=1) - 1
        grad_m[OUT] -= p[:, 0].sum(axis=0) - gold[:, 0].sum(axis=0)
        grad_m[:, OUT] -= (p[np.arange(n), last] - gold[np.arange(n), last]).sum(axis=0)
        np.add.at(grad_m, (tags[:, :-1][mask[:, 1:]], tags[:, 1:][mask[:, 1:]]), 1)
        diff = gold - p
        grad_w = np.zeros_like(w)
        for r in range(4):
            for y in range(3):
                grad_w[r, :, y] = np.bincount(feats[r].ravel(), np.repeat(diff[:, :, y].ravel(), most), minlength=DIM + 1)
        grad_w[:, DIM] = 0
        grad_f = np.zeros_like(f)
        np.add.at(grad_f, files.ravel(), np.repeat(diff.sum(axis=1), 2, axis=0))
        for k, g in enumerate((grad_w, grad_f, grad_m)):
            g -= l2 * params[k]
            seen[k] += g * g
            params[k] += 0.3 * g / np.sqrt(seen[k])
    field = Field()
    field.weights, field.file, field.moves = params[0][:, :DIM], params[1], params[2] + barred
    field.moves[OUT, INSIDE] = -math.inf
    return field


_FIELD: list[Field] = []


def field() -> Field:
    if not _FIELD:
        _FIELD.append(fit(made_lines(1000), steps=100))
    return _FIELD[0]


def uncovered(text: str, span: Span, base: list[Span]) -> list[Span]:
    """The pieces of a span that no base span covers, without white space around them."""
    kind, at, end = span
    pieces = []
    for a, b in sorted((a, b) for _, a, b in base if a < end and at < b):
        pieces.append((at, a))
        at = max(at, b)
    out = []
    for a, b in [*pieces, (at, end)]:
        if a < b and (inner := text[a:b].strip()):
            a = text.index(inner, a)
            out.append((kind, a, a + len(inner)))
    return out


def all_spans(text: str | None, crf: Field) -> list[Span]:
    """Base spans, and what the field's spans hold besides, by start, then kind as listed."""
    if not text:
        return []
    base = base_spans(text)
    more = [piece for s in crf.spans(text) for piece in uncovered(text, s, base)]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _map(df: DataFrame, schema: T.StructType, make) -> DataFrame:
    model = df.sparkSession.sparkContext.broadcast(field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield make(b, [all_spans(t, model.value) for t in b.column("text").to_pylist()])

    return df.mapInArrow(run, schema)


def scan(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (with a text column) and spans: array of (kind, start, end)."""
    df = df.drop(*[c for c in df.columns if c.lower() == "spans"])
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make(b: pa.RecordBatch, found: list[list[Span]]) -> pa.RecordBatch:
        rows = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], kind)
        return pa.RecordBatch.from_arrays([*b.columns, rows], names=[*b.schema.names, "spans"])

    return _map(df, T.StructType([*df.schema.fields, T.StructField("spans", T.ArrayType(span))]), make)


def digests(df: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row."""

    def make(b: pa.RecordBatch, found: list[list[Span]]) -> pa.RecordBatch:
        base = [[s for s in x if s[0] != "crf"] for x in found]
        count = lambda kind: pa.array([sum(s[0] == kind for s in x) for x in base], pa.int64())
        sha = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base])
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), count("assign"), count("access"), count("hex"), sha, pa.array([joined(x) for x in found], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return _map(df.select("doc_id", "text"), T.StructType.fromDDL(schema), make)


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every secret (a run of spans that overlap or touch) in its texts replaced by a mark; n_chars, where it is a column, follows."""

    def clean(text: str | None, spans: list[Span]) -> str | None:
        if not spans:
            return text
        out, at = [], -1
        for _, a, b in spans:
            if a > at:
                out += [text[max(at, 0) : a], mark]
            at = max(at, b)
        return "".join(out) + text[at:]

    def make(b: pa.RecordBatch, found: list[list[Span]]) -> pa.RecordBatch:
        texts = [clean(t, x) for t, x in zip(b.column("text").to_pylist(), found, strict=True)]
        new = {"text": pa.array(texts, pa.string())}
        if "n_chars" in b.schema.names:
            old = b.column("n_chars").to_pylist()
            new["n_chars"] = pa.array([len(t) if x else n for t, x, n in zip(texts, found, old, strict=True)], b.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)

    return _map(df, df.schema, make)
