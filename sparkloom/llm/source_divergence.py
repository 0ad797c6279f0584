"""Source divergence audit: how far the terms of each source of a language are from those of its other sources, and which terms stand out.

A term is a longest run of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased. A byte-level tokenizer finds them: a lookup table over the UTF-8 bytes of
a batch of texts, one after the other, gives 0 between terms and the lower-cased byte inside of them; the places where that changes, and the ends of texts, are the boundaries. Slices are
grouped by xxhash, and the bytes of each are compared with those of its group's first; what differs is grouped by its bytes. Counts and numbers of documents are added up
per batch and per task, then shuffled by (language, source, term), then by (language, term), so no key holds more rows than there are tasks or sources.

Each language keeps the terms of at least ``LEAST_DOCUMENTS`` of its rows. They are dealt over blocks of some ``BLOCK`` counts; a
block is a CSR matrix of sources by terms. For one source after the other, the divergence of all stored counts from that source's shares is taken at once and summed per row (``add.reduceat``);
terms that neither of two sources has add a constant each. Blocks give sums per pair of sources and the terms that stand out most per source, which Spark adds up and ranks.

The share of a term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)) with N counts over the V kept terms, a divergence floor((p - q)^2 / (p + q)). All arithmetic is exact in 64-bit integers,
up to some 9 * 10^15 counts.

Cases: a null text, language or source is the empty one. Rows without a term make their source occur. A language without kept terms has divergences of 0 and no terms. Repeated rows count each; ties
are ranked by the item's UTF-8 bytes. Columns besides lang, source and text are ignored; an empty table gives an empty result. The task of a
block holds its counts and a pair of numbers per source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, settled

LEAST_DOCUMENTS, TOP = 10, 10
SCALE_STEPS, STEP, SMOOTH = 3, 1000, 2  # shares are parts of STEP ** SCALE_STEPS
#: Bytes of text that are counted together; counts of a block.
TOGETHER, BLOCK = 4 << 20, 200_000


def lookup_table() -> np.ndarray:
    """Each byte inside a term as its lower case, other bytes as 0."""
    out = np.zeros(256, np.uint8)
    for b in (*range(ord("a"), ord("z") + 1), *range(128, 256)):
        out[b] = b
    for b in range(ord("A"), ord("Z") + 1):
        out[b] = b + 32
    return out


TABLE = lookup_table()


def terms_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, rows) of the terms of texts without nulls."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    low = TABLE[data]
    change = np.zeros(len(low) + 1, bool)  # a boundary before each byte, and at the end
    inside = low != 0
    change[1:-1] = inside[1:] != inside[:-1]
    change[bounds] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = inside[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return low, starts, ends, np.searchsorted(bounds, starts, "right") - 1


def grouped(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The group of each slice and the bytes of each group."""
    data, found = low.tobytes(), np.empty(len(starts), object)
    found[:] = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    _, first, group = np.unique(h, return_index=True, return_inverse=True)
    terms = found[first].tolist()
    same = (found == found[first[group]]).astype(bool)  # byte by byte
    more: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():  # another slice has this hash
        if found[i] not in more:
            more[found[i]] = len(terms)
            terms.append(found[i])
        group[i] = more[found[i]]
    return group, terms


def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some ``TOGETHER`` bytes of text, or one row."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            yield b.slice(at, to - at)
            at = to


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents per batch; a row without a term for each source that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            names = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True))
            known = {name: k for k, name in enumerate(dict.fromkeys(names))}
            source = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
            low, starts, ends, row = terms_in(b.column("text"))
            group, terms = grouped(low, starts, ends)
            width = max(len(terms), 1)
            per_doc, n = np.unique(row * width + group, return_counts=True)
            key = source[per_doc // width] * width + per_doc % width
            by = np.argsort(key, kind="stable")
            edge = np.flatnonzero(np.append(True, np.diff(key[by]) != 0)) if len(key) else by
            total = np.add.reduceat(n[by], edge) if len(key) else n
            in_docs, key = np.diff(np.append(edge, len(key))), key[by][edge]
            # rows of all sources without a term come first
            of = np.concatenate([np.arange(len(known)), key // width])
            term = pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(np.concatenate([np.zeros(len(known), np.int64), key % width]), mask=np.arange(len(of)) < len(known)))
            lang, name = (pa.array([x[k] for x in known], pa.string()).take(pa.array(of)) for k in (0, 1))
            counts = [pa.array(np.concatenate([np.zeros(len(known), np.int64), x])) for x in (total, in_docs)]
            yield pa.RecordBatch.from_arrays([lang, name, term, *counts], names=["lang", "source", "term", "n", "docs"])

    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return named.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / whole), by long division: no product beyond 64 bits."""
    rest, out = count + SMOOTH, np.zeros(np.broadcast(count, whole).shape, np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        out = out * STEP + rest // whole
        rest = rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def between(row: np.ndarray, column: np.ndarray, count: np.ndarray, whole: np.ndarray, width: int) -> np.ndarray:
    """Sums over a block's terms of the divergence of each pair of sources, from the stored counts of a CSR matrix (sorted by row) and each source's N + 2 V."""
    n = len(whole)
    p, none = shares(count, whole[row]), shares(np.zeros(n, np.int64), whole)
    bounds = np.searchsorted(row, np.arange(n + 1))
    some = np.flatnonzero(np.diff(bounds))
    stored = np.diff(bounds)
    out = np.zeros((n, n), np.int64)
    for h in range(n):
        own = slice(bounds[h], bounds[h + 1])
        q, has = np.full(width, none[h]), np.zeros(width, bool)
        q[column[own]], has[column[own]] = p[own], True
        f, lacks = divergence(p, q[column]), ~has[column]
        all_, only, number = (np.zeros(n, np.int64) for _ in range(3))
        if len(some):
            for to, x in ((all_, f), (only, f * lacks), (number, lacks.astype(np.int64))):
                to[some] = np.add.reduceat(x, bounds[some])
        out[:, h] += all_  # over terms of the row's source
        out[h] += only + (width - stored[h] - number) * divergence(none[h], none)  # terms of the column's source alone, and of neither
    return out


def standing_out(row: np.ndarray, column: np.ndarray, count: np.ndarray, whole: np.ndarray, language: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, divergences) of the terms of each source that are most above the language's share; ``order`` ranks terms by their bytes."""
    by = np.argsort(column, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(column[by]) != 0)) if len(by) else by
    total = np.add.reduceat(count[by], starts) if len(by) else count
    p, q = shares(count, whole[row]), shares(total, np.int64(language))[column]
    f = divergence(p, q)
    at = np.flatnonzero(p > q)
    at = at[np.lexsort((order[column[at]], -f[at], row[at]))]
    lead = np.flatnonzero(np.append(True, np.diff(row[at]) != 0)) if len(at) else at
    nth = np.arange(len(at)) - np.repeat(lead, np.diff(np.append(lead, len(at))))
    at = at[nth < TOP]
    return at, f[at]


def audit_block(key: tuple, counts: pa.Table, sources: pa.Table) -> pa.Table:
    """Pairs of sources and terms that stand out, of one block (source, term, n) of a language and all its sources (source, total, kept, all)."""
    lang = key[0].as_py()
    names = sorted(set(sources.column("source").to_pylist()), key=str.encode)
    place = {s: k for k, s in enumerate(names)}
    whole = np.zeros(len(names), np.int64)
    kept = int(sources.column("kept")[0].as_py())
    language = int(sources.column("all")[0].as_py()) + SMOOTH * kept
    for s, total in zip(sources.column("source").to_pylist(), sources.column("total").to_pylist(), strict=True):
        whole[place[s]] = total + SMOOTH * kept
    out_source, out_part, out_item, out_value = [], [], [], []
    sums = np.zeros((len(names), len(names)), np.int64)
    if len(counts):
        coded = counts.column("term").combine_chunks().dictionary_encode()
        terms = coded.dictionary.to_pylist()
        column = coded.indices.to_numpy().astype(np.int64)
        row = np.array([place[s] for s in counts.column("source").to_pylist()], np.int64)
        by = np.argsort(row, kind="stable")
        row, column, count = row[by], column[by], counts.column("n").to_numpy()[by]
        sums = between(row, column, count, whole, len(terms))
        order = np.zeros(len(terms), np.int64)
        order[sorted(range(len(terms)), key=lambda i: terms[i].encode())] = np.arange(len(terms))
        at, f = standing_out(row, column, count, whole, language, order)
        out_source += [names[k] for k in row[at].tolist()]
        out_item += [terms[k] for k in column[at].tolist()]
        out_part += ["term"] * len(at)
        out_value += f.tolist()
    for g, s in enumerate(names):
        out_source += [s] * (len(names) - 1)
        out_item += names[:g] + names[g + 1 :]
        out_part += ["pair"] * (len(names) - 1)
        out_value += np.delete(sums[g], g).tolist()
    arrays = [pa.array([lang] * len(out_part), pa.string()), pa.array(out_source, pa.string()), pa.array(out_part, pa.string()), pa.array(out_item, pa.string()), pa.array(out_value, pa.int64())]
    return pa.Table.from_arrays(arrays, names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source, text).

    Part pair: the source's summed divergence from each other source of its language, all ranks; part term: the terms whose share
    is above the language's and differs most, to rank ``TOP``. Ranks fall with the value."""
    return settled(lambda: _audit(docs), "divergence")


def _audit(docs: DataFrame) -> DataFrame:
    counts = cut(counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCUMENTS).select("lang", "term")
    kept = cut(counts.filter("term IS NOT NULL").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    languages = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("stored"))
    languages = languages.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("all"), F.ceil(F.sum("stored") / BLOCK).alias("blocks"))
    sources = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    sources = cut(sources.fillna(0, ["total", "kept", "all"]).fillna(1, ["blocks"]), "sources")
    blocks = sources.select("lang", "blocks").distinct()
    dealt = kept.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n")
    every = sources.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "total", "kept", "all")
    parts = dealt.groupBy("lang", "block").cogroup(every.groupBy("lang", "block")).applyInArrow(audit_block, "lang string, source string, part string, item string, value long")
    found = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term stands in one block
    by = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return found.withColumn("rank", F.row_number().over(by).cast("int")).filter((F.col("part") == "pair") | (F.col("rank") <= TOP))
