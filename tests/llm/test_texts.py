"""Periodic runs, source divergences and token counts against brute force, SQL's rules in plain Python, and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import periodic_runs, registry, source_divergence, token_counts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, runs string, n_tokens string, rank int"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def odd_rows():
    long_text = " ".join(f"w{k % 7}" if 5_000 < k < 9_000 else f"x{k}" for k in range(20_000))
    texts = [None, "", " \n\t", "one", "a b " * 40, "a b " * 40, long_text, "ü" * 30_000, "<|endoftext|> x<|endoftext|>", "a\x00b \x85 é"]
    rows = [(k, t, "en", f"s{k % 3}", "r", "n", 1) for k, t in enumerate(texts)]
    return [*rows, rows[4], (None, "null id " * 10, None, None, None, None, None), (None,) * 7]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


# ---- periodic runs


def plain_runs(words):
    """Every stretch that keeps a period, for one period after the other."""
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(6, 4 * p):
                out.setdefault((start, i + p), p)
            i += i == start
            if i > start and i + p < n and words[i] != words[i + p]:
                i += 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def made_text(rnd):
    letters = "ab"[: rnd.randint(1, 2)] + "cdefg"[: rnd.randint(0, 5)]
    words = [rnd.choice(letters) for _ in range(rnd.randint(0, 80))]
    for _ in range(rnd.randint(0, 3)):
        period = [rnd.choice("abc") for _ in range(rnd.randint(1, 6))]
        words[rnd.randint(0, len(words)) : 0] = (period * 8)[: rnd.randint(1, 40)]
    return words


@pytest.mark.parametrize("prime, pairs", [(periodic_runs.PRIME, 1 << 20), (13, 1 << 20), (251, 7), (periodic_runs.PRIME, 7)])
def test_runs_against_plain_search_also_with_hashes_that_collide(monkeypatch, prime, pairs):
    monkeypatch.setattr(periodic_runs, "PRIME", prime)
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 1000)
    rnd = random.Random(4)
    texts = [made_text(rnd) for _ in range(400)] + [["a"] * 300, ["a", "b"] * 200]
    got = [r for group in periodic_runs.together(texts) for r in periodic_runs.runs_of(group)]
    assert got == [plain_runs(t) for t in texts]
    assert sum(map(len, got)) > 100


def test_greatest_run_is_exact_in_ties():
    assert periodic_runs.greatest([(5, 12, 2), (1, 18, 3), (1, 6, 1)]) == (1, 6, 1)
    assert periodic_runs.greatest([(0, 10**17 + 1, 10**16), (9, 10**17, 10**16)]) == (0, 10**17 + 1, 10**16)
    assert periodic_runs.greatest([]) is None


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    out = (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2])
    return (doc_id, *out, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_the_query_against_plain_search(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [tuple(r) for r in registry.op11_periodic_runs(spark, SF).collect()]
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got) > 10
    for r in got:
        if len(WORD.findall(rows[r[0]] or "")) < 3000:
            assert r == plain_row(r[0], rows[r[0]])


def test_odd_texts_have_defined_runs(spark, odd):
    found = periodic_runs.detect(odd)
    assert found.columns == ["doc_id", "lang", "source", "n_tokens", "rank", "runs", "greatest", "collapsed"]
    got = {(r.doc_id, r.lang): r for r in found.collect()}
    assert found.count() == odd.count()
    for k in (0, 1, 2):
        assert got[k, "en"].runs == [] and got[k, "en"].greatest is None and got[k, "en"].collapsed == ""
    assert got[5, "en"].runs == got[4, "en"].runs and got[4, "en"].collapsed == "a b"
    assert tuple(got[6, "en"].greatest) == (5001, 3999, 7)
    assert periodic_runs.digests(periodic_runs.detect(periodic_runs.with_periods(odd.limit(0)))).count() == 0
    rows = odd_rows()
    want = sorted([plain_row(r[0], r[1]) for r in rows if len(WORD.findall(r[1] or "")) < 5000], key=str)
    all_ = periodic_runs.digests(periodic_runs.detect(periodic_runs.with_periods(odd)))
    assert sorted([tuple(r) for r in all_.collect() if r.doc_id != 6], key=str) == want


# ---- source divergences


def plain_audit(rows):
    """The contract's rules, one number after the other."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = [t.translate(lower) for t in term.findall(text or "")]
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= 10]
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def shares(c):
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // whole for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:10]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(ranked)]
    return sorted(out)


def made_sources():
    rnd = random.Random(8)
    words = ["the", "The", "ÉTÉ", "été", "naïve", "x1y", "don't", "中文", "zeta", "eta", "A-b", "😀q"]
    rows = [(rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", None, ""]), " ".join(rnd.choices(words, range(1, 13), k=rnd.randint(0, 30)))) for _ in range(400)]
    # a language without kept terms, a source without terms, nulls
    return rows + [("fr", "a", "rare"), ("fr", "b", None), ("en", "empty", "1 2 3"), ("en", "empty", None), (None, None, None), ("en", "s1", "x" * 100_000)]


@pytest.mark.parametrize("block", [200_000, 3])
def test_divergences_against_plain_arithmetic(spark, monkeypatch, block):
    monkeypatch.setattr(source_divergence, "BLOCK", block)
    rows = made_sources()
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "lang string, source string, text string, n long, term string, value string").repartition(3)
    got = source_divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows)


def test_no_documents_no_divergences(spark):
    assert source_divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    one = spark.createDataFrame([("en", "s", "a b")], "lang string, source string, text string")
    assert source_divergence.audit(one).count() == 0


def test_slices_whose_hashes_collide_are_kept_apart(monkeypatch):
    monkeypatch.setattr(source_divergence.xxhash, "xxh3_64_intdigest", lambda b: len(b) % 2)
    texts = pa.array(["Ab cd ab", "", "éa x", "cd-abc Ab"])
    low, starts, ends, row = source_divergence.terms_in(texts)
    group, terms = source_divergence.grouped(low, starts, ends)
    assert [terms[g].decode() for g in group] == ["ab", "cd", "ab", "éa", "x", "cd", "abc", "ab"]
    assert len(set(group.tolist())) == 5 and row.tolist() == [0, 0, 0, 2, 2, 3, 3, 3]


def test_terms_end_with_their_text_also_in_sliced_columns():
    texts = pa.array(["skip", "ab", "cd", "", "ef"]).slice(1)
    low, starts, ends, row = source_divergence.terms_in(texts)
    assert [low[a:b].tobytes() for a, b in zip(starts, ends)] == [b"ab", b"cd", b"ef"] and row.tolist() == [0, 1, 3]


def test_batches_are_cut_by_their_text(monkeypatch):
    monkeypatch.setattr(source_divergence, "TOGETHER", 10)
    b = pa.RecordBatch.from_arrays([pa.array(["", "abc", "x" * 50, "", "abcdefgh", "ab", "c"])], names=["text"]).slice(1)
    assert [p.column("text").to_pylist() for p in source_divergence.in_pieces(iter([b]))] == [["abc"], ["x" * 50], ["", "abcdefgh", "ab"], ["c"]]


def test_shares_are_exact_for_large_counts():
    counts, whole = np.array([0, 1, 10**15, 9 * 10**15 - 5]), np.int64(9 * 10**15)
    assert source_divergence.shares(counts, whole).tolist() == [1 + 10**9 * (c + 2) // int(whole) for c in counts.tolist()]


# ---- token counts


@pytest.fixture(scope="module")
def byte_level():
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return token_counts.Counter(f.read()), Tokenizer.from_file(path)


def library_counts(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_every_code_point_is_counted_as_in_the_library(byte_level):
    own, library = byte_level
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2  {chr(c)}\n" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    assert own.counts(texts) == library_counts(library, texts)


@pytest.mark.parametrize("ordered", [True, False])
def test_mixed_texts_are_counted_as_in_the_library(byte_level, monkeypatch, ordered):
    own, library = byte_level
    assert own.ordered
    monkeypatch.setattr(own, "ordered", ordered)
    monkeypatch.setattr(own, "cache", {})
    monkeypatch.setattr(own, "older", {})
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 500)
    monkeypatch.setattr(token_counts, "LONG", 2_000)
    monkeypatch.setattr(token_counts, "AT_ONCE", 100)
    rnd = random.Random(6)
    pieces = ["a", "b", "the", "<|endoftext|>", "'s", "'", "  ", "\n", "\t", "\xa0", " ", "1", "23", "é", "中", "😀", "aaaa", "!!", "\x00", "\x1c", "\x85", "ß"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randint(0, 60))) for _ in range(2000)]
    n = 50_000 if ordered else 300
    texts += [None, "", "<|endoftext|>", "a" * n, " " * n, "ab" * n, "中文字" * n, "".join(rnd.choices("abcdefgh", k=n)), "of the people " * n]
    assert own.counts(texts) == library_counts(library, texts)


def test_counts_of_the_query(spark, byte_level):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.op13_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    want = dict(zip(texts, library_counts(byte_level[1], texts.values()), strict=True))
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), want[r.doc_id], want[r.doc_id] > 512)


def test_odd_texts_are_counted(spark, odd, byte_level):
    path = registry.tokenizer_path("byte_bpe_50k.json")
    got = token_counts.count(odd, path)
    assert got.columns == ["doc_id", "lang", "source", "runs", "rank", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((r[0], n) for r, n in zip(odd_rows(), library_counts(byte_level[1], [r[1] for r in odd_rows()]), strict=True))
    assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == want
    assert token_counts.count(odd.limit(0), path).filter(F.col("n_tokens") > 0).count() == 0
