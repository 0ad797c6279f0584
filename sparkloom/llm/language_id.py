"""Language ID by hierarchical discrimination.

A first level of linear classifiers picks the language family; within it, one-versus-one linear
support vector machines separate the languages, and the language with most votes (then the larger
margin) wins. Features are hashed 1-, 2- and 3-grams of lower-cased letters with word boundaries,
as shares of a text's n-grams, so a score is a sum over the whole text.

Training reads the text and the non-null language of labelled rows only, of a sample that is
bounded by ``PER_LANGUAGE`` different rows of each language and ``TOTAL`` rows in all, chosen by a hash of
id and text; every language takes part as long as there are no more than ``TOTAL``. The executors count the sample's n-grams; the driver fits the machines (squared hinge,
accelerated gradient steps, no randomness). Neither the source nor the id nor the row's own language enters a
prediction. A family of more than ``FAMILY_SIZE`` learned languages is split by name.

Cases: a null text, an empty one or one without a letter is ``und`` with score 0; without any
labelled row every text is. Exact copies get equal results. If only one language is learned it is predicted
with score 1. Languages with equally many votes are told apart by the sum of their margins, then the name that sorts last wins; a margin of zero is a vote for
the name that sorts first. Texts of any length are scored over pieces of ``PIECE`` characters; each n-gram belongs to the piece it starts in, so the score does not
depend on the pieces. Memory is bounded by the longest single text. Columns that clash with lang_pred and score are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import cut, discard, slices

#: Bounds of the training sample, and most languages that are told apart pairwise.
PER_LANGUAGE, TOTAL, FAMILY_SIZE = 250, 4000, 24
#: Hashed features.
BITS = 14
DIM = 1 << BITS
PIECE = 1 << 20
#: Families of languages by ISO 639-1 code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "indo-aryan": "hi bn ur mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv su mg",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"own:{lang}")


def families_of(languages: list[str]) -> dict[str, str]:
    """The family of each language; large ones are split into runs of names."""
    own: dict[str, list[str]] = {}
    for lang in sorted(languages):
        own.setdefault(family_of(lang), []).append(lang)
    return {lang: f"{f}:{k // FAMILY_SIZE}" if len(members) > FAMILY_SIZE else f for f, members in own.items() for k, lang in enumerate(members)}


_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once in each process."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str, starts: int) -> np.ndarray:
    """Hashed n-grams of a lower-cased text that start at its first so many places; none if there is no letter."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    own = letters()[c]
    c = np.where(own, c, np.uint32(32))
    mix, shift = np.uint32(2654435761), np.uint32(32 - BITS)
    one = (c[:starts][own[:starts]] * np.uint32(31) + np.uint32(1)) * mix >> shift
    pair = c[:-1] * np.uint32(0x9E3B) + c[1:]
    two = (pair * np.uint32(3) + np.uint32(2)) * mix >> shift
    three = ((pair[:-1] * np.uint32(0x85EB) + c[2:]) * np.uint32(5) + np.uint32(3)) * mix >> shift
    # an n-gram needs a letter at its second place: runs of other characters count once
    return np.concatenate([one, two[:starts][(own[1:] | own[:-1])[:starts]], three[:starts][own[1:-1][:starts]]])


def pieces(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text, by pieces."""
    lowered = text.lower()
    for at in range(0, len(lowered), PIECE):
        yield grams(lowered[at : at + PIECE + 2], PIECE)


def shares(text: str | None) -> np.ndarray | None:
    """A text's feature vector."""
    total, n = np.zeros(DIM, np.float32), 0
    for g in pieces(text or ""):
        total += np.bincount(g, minlength=DIM)
        n += len(g)
    return total / n if n else None


@dataclass
class Heads:
    """Linear heads over the features. family: one per family, against the rest; pairs: (a, b) and a
    head that is positive for a, within each family."""

    languages: list[str]
    families: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    #: Of each family: its languages, and where its pairs start.
    members: dict[str, tuple[list[str], int]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIM, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return "und", 0.0
        total, n = np.zeros(len(self.bias)), 0
        for g in pieces(text):
            total += self.weights[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return self.decide(total / n + self.bias) if n else ("und", 0.0)

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        k = len(self.families)
        sure = 1.0
        if k > 1:
            odds = np.exp(np.clip(2 * (margins[:k] - margins[:k].max()), -50, 0))
            best = int(margins[:k].argmax())
            sure = float(odds[best] / odds.sum())
            family = self.families[best]
        else:
            family = self.families[0]
        own, first = self.members[family]
        if len(own) == 1:
            return own[0], sure
        count = len(own) * (len(own) - 1) // 2
        found = list(zip(self.pairs[first : first + count], margins[k + first : k + first + count], strict=True))
        votes = {x: [0, 0.0] for x in own}
        for (a, b), m in found:
            winner = a if m >= 0 else b
            votes[winner][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        lang = max(own, key=lambda x: (*votes[x], x))
        worst = min(m if a == lang else -m for (a, b), m in found if lang in (a, b))
        return lang, sure * float(1 / (1 + np.exp(-np.clip(2 * worst, -50, 50))))


def machine(xb: np.ndarray, y: np.ndarray, steps: int = 120, c: float = 50.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss over rows whose last column is 1; y is 1 or -1, classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * c
    # the loss' curvature is at most 1 + 2 |X' D X|
    v = np.ones(xb.shape[1], np.float32)
    for _ in range(20):
        v = xb.T @ (weight * (xb @ v))
        norm = np.linalg.norm(v)
        v /= norm or 1
    rate = 1 / (1 + 2.2 * norm)
    shrink = np.r_[np.ones(xb.shape[1] - 1), 0].astype(np.float32)
    w = ahead = np.zeros(xb.shape[1], np.float32)
    for k in range(steps):
        gap = np.maximum(0, 1 - y * (xb @ ahead))
        new = ahead - rate * (ahead * shrink - 2 * xb.T @ (weight * gap * y))
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit(xb: np.ndarray, langs: list[str]) -> Heads:
    """Heads from feature vectors, whose last column is 1, and their languages. The vectors are scaled in place: they stand in memory once, and the rows of two languages again."""
    heads = Heads(sorted(set(langs)))
    if not heads.languages:
        return heads
    family = families_of(heads.languages)
    of = np.array([family[x] for x in langs])
    names = np.array(langs)
    heads.families = sorted(set(family.values()))
    x = xb[:, :-1]
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5)
    x *= scale
    norm = np.sqrt(np.mean([row @ row for row in x]))
    x /= norm
    scale = (scale / norm).astype(np.float32)
    made = []
    if len(heads.families) == 2:  # one machine tells two families apart
        w, b = machine(xb, np.where(of == heads.families[0], 1, -1).astype(np.float32))
        made += [(w, b), (-w, -b)]
    elif len(heads.families) > 2:
        made += [machine(xb, np.where(of == f, 1, -1).astype(np.float32)) for f in heads.families]
    else:
        made.append((np.zeros(x.shape[1], np.float32), 0.0))
    for f in heads.families:
        own = [x for x in heads.languages if family[x] == f]
        heads.members[f] = (own, len(heads.pairs))
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                rows = (names == a) | (names == b)
                heads.pairs.append((a, b))
                made.append(machine(xb[rows], np.where(names[rows] == a, 1, -1).astype(np.float32)))
    heads.weights = np.empty((DIM, len(made)), np.float32)
    for k, (w, _) in enumerate(made):
        heads.weights[:, k] = w * scale
    heads.bias = np.array([b for _, b in made], np.float32)
    return heads


def sample_of(labelled: DataFrame) -> DataFrame | None:
    """Different rows (lang, text) to learn from: of each language those with the smallest hashes of id and text, at most ``PER_LANGUAGE`` and ``TOTAL`` in all."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"), "text").alias("_h"), "text")
    counts = cut(rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n")), "languages")
    n = counts.count()
    if not n:
        discard(counts)
        return None
    each = max(1, min(PER_LANGUAGE, TOTAL // n))
    # of large languages only hashes below a bound, some four times as many as are needed, are ordered
    bound = F.lit(-float(1 << 63)) + F.least(F.lit(1.0), F.lit(4.0 * each + 20) / F.col("_n")) * float(1 << 64)
    few = rows.select("lang", "_h").join(counts, "lang").filter(F.col("_h").cast("double") <= bound).select("lang", "_h").distinct()
    ranked = few.withColumn("_k", F.row_number().over(W.partitionBy("lang").orderBy("_h"))).filter(F.col("_k") <= each)
    chosen = ranked.orderBy("_k", "_h", "lang").limit(TOTAL).collect()
    discard(counts)
    # at most TOTAL rows of two short values
    chosen = labelled.sparkSession.createDataFrame([(r["lang"], r["_h"]) for r in chosen], "lang string, _h long")
    return rows.join(F.broadcast(chosen), ["lang", "_h"], "left_semi").dropDuplicates(["lang", "_h"]).select("lang", "text")


def train(labelled: DataFrame) -> Heads:
    """Fit on a bounded sample of ``labelled`` (doc_id, lang, text)."""
    sample = sample_of(labelled)
    if sample is None:
        return Heads([])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows = [(k, zlib.compress(v.tobytes(), 1)) for k, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) if (v := shares(t)) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([v for _, v in rows], pa.binary())], names=["lang", "v"])

    rows = sample.mapInArrow(count, "lang string, v binary").collect()
    if not rows:
        return Heads([])
    rows.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    xb = np.ones((len(rows), DIM + 1), np.float32)
    for own, r in zip(xb, rows, strict=True):
        own[:-1] = np.frombuffer(zlib.decompress(r["v"]), np.float32)
    return fit(xb, [r["lang"] for r in rows])


def predict(df: DataFrame, heads: Heads) -> DataFrame:
    """The rows of ``df`` (with a text column) and lang_pred, score."""
    df = df.drop(*[c for c in df.columns if c.lower() in ("lang_pred", "score")])
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    model = df.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for b in slices(batches):
            found = [own.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[*b.schema.names, "lang_pred", "score"],
            )

    return df.mapInArrow(run, schema)


def held_out() -> F.Column:
    """Documents that nothing may be learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
