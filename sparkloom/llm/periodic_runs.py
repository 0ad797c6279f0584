"""Periodic run detection on a harmonic grid with prefix hashes.

A run is a stretch of words with smallest period q, as long as it can be with that period, and of at least
``LEAST`` words and ``TIMES`` periods. For each period p up to a ``TIMES``-th of a text the grid has the points 0, p, 2p ...: some n log n pairs (p, point) for n words.
A run of period p covers a point whose next 2p words equal those one period on, so one comparison of prefix hashes, made
for all pairs at once, leaves the pairs that lie in runs. For all of these, two binary searches run side by side
over prefix hashes: how far the equality goes on to the right (longest common extension), and how far to the left.

Hashes may agree by chance, so equal extents are merged, the smallest period of each is checked word by word, and pairs
that fail are measured on the words themselves. A stretch that a multiple of its period finds again is the same run: it is kept once.

Words are numbered per batch of texts; texts stand in one array with separators that occur once, so a comparison cannot reach
into the next text. Pairs are made in blocks of ``PAIRS``, so memory is in proportion to the batch or to its one longest text.

Cases: a null text, or one without a word, has no words, no runs and an empty collapsed text. Repeated rows
and copies are answered alike; an empty table gives an empty result; columns that clash with the result's are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import WORD, barrier, slices

#: A run has at least so many words and so many periods.
LEAST, TIMES = 6, 4
#: Words of texts that are worked on together, and pairs of a block.
BATCH_WORDS, PAIRS = 1 << 18, 1 << 20
#: Prefix hashes are polynomials modulo this prime, so that products fit 64 bits.
PRIME = (1 << 31) - 1
FIND = re.compile(WORD).findall
Run = tuple[int, int, int]  # start, length, period


class Hashes:
    """Prefix hashes of an array of word numbers."""

    def __init__(self, words: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        base = int(rng.integers(PRIME // 4, PRIME // 2))
        values = rng.integers(1, PRIME, int(words.max(initial=0)) + 1, dtype=np.uint64)
        self.power = np.ones(len(words) + 1, np.uint64)
        done = 1
        while done < len(self.power):  # doubled each time
            more = self.power[: min(done, len(self.power) - done)]
            self.power[done : done + len(more)] = more * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
            done += len(more)
        self.prefix = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(values[words] * self.power[:-1] % np.uint64(PRIME), out=self.prefix[1:])
        self.prefix %= np.uint64(PRIME)

    def equal(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from each place seem to equal those a period on."""
        m, h = np.uint64(PRIME), self.prefix
        near = (h[at + length] + m - h[at]) * self.power[period] % m
        far = (h[at + period + length] + m - h[at + period]) % m
        return near % m == far


def extents(h: Hashes, at: np.ndarray, period: np.ndarray, low: np.ndarray, high: np.ndarray, back: bool) -> np.ndarray:
    """How many words from each place on (or before it) seem to equal those a period on: ``low`` do for sure, ``high`` at most."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_] + 1) // 2
        a, p = at[open_], period[open_]
        fits = h.equal(a - middle if back else a, p, middle)
        low[open_[fits]] = middle[fits]
        high[open_[~fits]] = middle[~fits] - 1
        open_ = open_[low[open_] < high[open_]]
    return low


def measured(words: np.ndarray, at: int, period: int, first: int, end: int) -> tuple[int, int]:
    """(start, end) of the stretch around a place that keeps a period, from the words themselves."""
    differ = np.flatnonzero(words[at : end - period] != words[at + period : end])
    stop = (at + int(differ[0]) if len(differ) else end - period) + period
    differ = np.flatnonzero(words[first:at] != words[first + period : at + period])
    return (first + int(differ[-1]) + 1 if len(differ) else first), stop


def grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of every pair of the harmonic grid of texts (start and number of words), in blocks."""
    periods = sizes // TIMES
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = sizes[text] // period - 2  # the words of a point and the two periods after it lie within the text
    total = np.cumsum(points)
    at = 0
    while at < len(text):
        before = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        n = points[at:to]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        t, p = np.repeat(text[at:to], n), np.repeat(period[at:to], n)
        yield t, p, starts[t] + k * p
        at = to


def checked(known: np.ndarray, new: np.ndarray, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, end, period, text, place), a row per run and right to the word, of those that are known to be so and those that hash comparisons found."""
    rows, exact = np.concatenate([known, new]), np.arange(len(known) + len(new)) < len(known)
    while True:
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
        rows, exact = rows[order], exact[order]
        lead = np.ones(len(rows), bool)
        lead[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        of = np.cumsum(lead) - 1
        kept = rows[lead]
        # the smallest period of each stretch, word by word; the others must be multiples of it
        good = np.array([sure or np.array_equal(words[s : e - p], words[s + p : e]) for sure, (s, e, p) in zip(exact[lead], kept[:, :3].tolist(), strict=True)], bool)
        wrong = np.flatnonzero(~exact & (~good[of] | (rows[:, 2] % kept[of, 2] != 0))).tolist() if len(rows) else []
        if not wrong:
            return kept
        for k in wrong:
            _, _, p, t, x = rows[k].tolist()
            rows[k, :2] = measured(words, x, p, int(starts[t]), int(starts[t] + sizes[t]))
        exact[wrong] = True
        keep = rows[:, 1] - rows[:, 0] >= np.maximum(LEAST, TIMES * rows[:, 2])
        rows, exact = rows[keep], exact[keep]


def runs_in(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, Run]]:
    """(text, run) of each run of texts that stand in one array, by start and period; starts of runs count from the text's own."""
    h = Hashes(words)
    rows = np.zeros((0, 5), np.int64)
    for t, p, x in grid(starts, sizes):
        # cheap comparisons of single words first
        keep = np.flatnonzero(words[x] == words[x + p])
        keep = keep[words[x[keep] + 2 * p[keep] - 1] == words[x[keep] + 3 * p[keep] - 1]]
        t, p, x = t[keep], p[keep], x[keep]
        keep = h.equal(x, p, 2 * p)
        t, p, x = t[keep], p[keep], x[keep]
        right = extents(h, x, p, 2 * p, starts[t] + sizes[t] - x - p, back=False)
        left = extents(h, x, p, np.zeros_like(x), x - starts[t], back=True)
        start, end = x - left, x + right + p
        keep = end - start >= np.maximum(LEAST, TIMES * p)
        rows = checked(rows, np.stack([start, end, p, t, x], axis=1)[keep], words, starts, sizes)
    return [(t, (s - int(starts[t]), e - s, p)) for s, e, p, t, _ in rows[np.lexsort((rows[:, 2], rows[:, 0]))].tolist()]


def greatest(runs: list[Run]) -> Run | None:
    """The run with the greatest length by period; of ties the first, then that with the smallest period."""
    best = None
    for run in runs:
        if best is None or (d := run[1] * best[2] - best[1] * run[2]) > 0 or (d == 0 and (run[0], run[2]) < (best[0], best[2])):
            best = run
    return best


def collapsed(words: list[str], runs: list[Run]) -> str:
    """The words but those of runs beyond a run's first period, joined by a space."""
    if not runs:
        return " ".join(words)
    inside = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(runs).T
    np.add.at(inside, start + period, 1)
    np.add.at(inside, start + length, -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist()])


def runs_of(texts: list[list[str]]) -> list[list[Run]]:
    """The runs of each text, given as its words."""
    number: defaultdict[str, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    for k, t in enumerate(texts):
        words[starts[k] : starts[k] + len(t)] = np.fromiter(map(number.__getitem__, t), np.int64, len(t))
    words[starts + sizes] = len(number) + np.arange(len(texts))
    out: list[list[Run]] = [[] for _ in texts]
    for t, run in runs_in(words, starts, sizes):
        out[t].append(run)
    return out


def together(texts: list[list[str]]) -> Iterator[list[list[str]]]:
    """The texts in groups of so many words, or one text."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > BATCH_WORDS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
ADDED = {"runs": T.ArrayType(RUN, False), "greatest": RUN, "collapsed": T.StringType()}
ARROW_RUN = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with runs (start, length, period; by start, then period), the greatest of them, and the collapsed text, in place of its text column."""
    rest = df.drop(*[c for c in df.columns if c.lower() in ADDED and c != text])
    kept = [f for f in rest.schema.fields if f.name != text]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in ADDED.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_struct = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
        for b in slices(batches):
            texts = [FIND(t) if t else [] for t in b.column(text).to_pylist()]
            runs = [r for group in together(texts) for r in runs_of(group)]
            columns = [
                pa.array([list(map(as_struct, r)) for r in runs], pa.list_(pa.field("element", ARROW_RUN, False))),
                pa.array([as_struct(greatest(r)) for r in runs], ARROW_RUN),
                pa.array([collapsed(t, r) for t, r in zip(texts, runs, strict=True)], pa.string()),
            ]
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *columns], names=[*names, *ADDED])

    return rest.mapInArrow(run, schema)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of a tenth of the documents, chosen by a hash of their id, the words from some place on repeat with a period. Rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("_words"))
    rows = barrier(rows, "_words")
    n, g = F.size("_words").cast("long"), F.floor(F.col("_h") / 10).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    return rows.select("doc_id", F.when(F.col("_words").isNotNull() & (n > 0), repeated(F.col("_words"), n, a, p)).otherwise(F.col("text")).alias("text"))


def repeated(words: Column, n: Column, a: Column, p: Column) -> Column:
    """The words joined by a space, each from a on being that at a + (i - a) % p."""
    part = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    copies = F.flatten(F.array_repeat(part, F.ceil((n - a) / p).cast("int")))
    head = F.slice(words, F.lit(1), a.cast("int"))
    return F.array_join(F.concat(head, F.slice(copies, F.lit(1), (n - a).cast("int"))), " ")


def digests(found: DataFrame) -> DataFrame:
    """One row per document of ``detect``: counts, the greatest run and digests."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.col("greatest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * greatest.length) div greatest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
