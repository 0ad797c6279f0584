"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Words, 1-grams and 2-grams of words are hashed into ``BUCKETS`` buckets. One multinomial is
estimated over the documents that labels call good (the trusted target), one over all documents (the
raw corpus), both with ``PRIOR`` pseudo-counts spread like the raw corpus. A document's score is the mean over its n-grams of
log(target / raw): the log-likelihood ratio by length. Every document with a score of at least a threshold is kept by the method. The threshold comes
from all labelled rows that are not trusted (all bad ones, and the tenth of the good ones that is held out):
where the share of bad rows kept and that of good rows lost have the smallest sum. Without such rows of both kinds it is ``THRESHOLD``.

The raw counts cover all documents, the target's all trusted ones. Both come from one pass that aggregates before
its shuffle; trusted ids are broadcast as bits, and texts are shuffled only where ids are no whole numbers or lie too far apart for that (``with_trust``). The counts of the ``BUCKETS`` buckets go to the driver, and their ratios
enter the second pass as a literal. That one judges each document once; the threshold is found over its scores, in ranges of ``SPAN``, of which the numbers go to the driver. Only DataFrame functions are used.

Cases: a null or empty text, or one of white space alone, has no words: all counts are 0, base_failed is true
(fewer than 10 words) and the score is null. Without trusted documents every score is 0, so the method keeps all. A document labelled
more than once counts once; repeated documents count as often as they stand in the table. Words are hashed with 64 bits, so two different
windows of one text are taken for equal with a chance below 1e-9 for texts of 100,000 words. Columns that clash with the result's are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, barrier
from sparkloom.sources.shared import written

BUCKETS = 1 << 13
#: Words of 64 ids that are broadcast (24 MB of rows).
MOST_WORDS = 1 << 20
PRIOR = 4096.0
#: Width of the ranges of scores within which places of a threshold are compared.
SPAN = 1e-3
#: The mean log ratio that a document needs where labels do not tell it.
THRESHOLD = -0.12
WINDOW = 5
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def pair(x: Column, y: Column) -> Column:
    """Hash of a 2-gram, from the hashes of its words."""
    return F.shiftleft(x, 7).bitwiseXOR(y)


def bucket(x: Column) -> Column:
    """Bucket of a 1-gram, from the hash of its word."""
    return x.bitwiseAND(F.lit(BUCKETS - 1))


def pair_bucket(g: Column) -> Column:
    """Bucket of a 2-gram, from its hash."""
    return bucket(F.shiftrightunsigned(g, 17))


def part(array: Column, first: int, but: int) -> Column:
    """An array's elements from the ``first`` on (1 is the first of all), ``but`` fewer than it has."""
    return F.slice(array, first, F.greatest(F.size(array) - but, F.lit(0)))


def windows(h: Column) -> Column:
    """Hashes of a text's windows of five words, from its word hashes."""
    whole = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
    return F.transform(whole, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))


def count_repeated(w: Column) -> tuple[Column, Callable[[Column], Column]]:
    """From window hashes: the hashes with their places, sorted, so that equal windows are neighbours;
    and, from those, the number of words that repeated windows cover."""

    def places(s: Column) -> Column:
        same = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    sorted_windows = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return sorted_windows, lambda s: covered(places(s))


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the base counts, base_failed, the hashes of the words and 2-grams, and the buckets of the n-grams.

    Lambda functions are interpreted, element by element, so each does little, and slices, distinct values and sizes stand in
    selects of their own, which are compiled. The 5-word windows are hashed and sorted only for texts that hold one twice, its middle word left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("_text"), words(F.col("text")).alias("_words"))
    out = out.select(
        "doc_id",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    out = barrier(out, "_lines", "_h").select(
        "doc_id",
        F.size("_h").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "_h",
        part(F.col("_h"), 1, 1).alias("_x"),
        part(F.col("_h"), 2, 1).alias("_y"),
    )
    out = barrier(out.withColumn("_g", F.zip_with("_x", "_y", pair)).drop("_x", "_y"), "_g")
    out = out.withColumns({"_x": part(F.col("_g"), 1, WINDOW - 2), "_y": part(F.col("_g"), WINDOW - 1, WINDOW - 2)})
    out = barrier(out.withColumn("_ends", F.zip_with("_x", "_y", lambda x, y: F.shiftleft(x, 13).bitwiseXOR(y))).drop("_x", "_y"), "_ends")
    out = out.withColumn("_repeats", F.size(F.array_distinct("_ends")) < F.size("_ends")).drop("_ends")
    out = barrier(out.withColumn("_w", F.when(F.col("_repeats"), windows(F.col("_h")))), "_w")
    sorted_windows, covered = count_repeated(F.col("_w"))
    out = barrier(out.withColumn("_sorted", F.when(F.col("_repeats"), sorted_windows)), "_sorted")
    out = out.withColumn("n_repeat_words", F.when(F.col("_repeats"), covered(F.col("_sorted"))).otherwise(0).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    all_buckets = F.concat(F.transform("_h", lambda x: bucket(x).cast("int")), F.transform("_g", lambda g: pair_bucket(g).cast("int")))
    return out.withColumns({"base_failed": failed, "_buckets": all_buckets}).drop("_w", "_sorted", "_repeats")


def with_trust(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``docs`` with ``_t``, 1 if the id is among ``trusted`` (doc_id), else 0.

    Whole numbers are sent to all tasks as words of 64 bits, so texts stay where they are; other ids, and more than ``MOST_WORDS`` words of them, are joined as they are."""
    whole = {"tinyint", "smallint", "int", "bigint"}
    if {docs.schema["doc_id"].dataType.simpleString(), trusted.schema["doc_id"].dataType.simpleString()} <= whole:
        word, bit = F.expr("shiftright(CAST(doc_id AS BIGINT), 6)"), "CAST(doc_id & 63 AS INT)"
        words = trusted.filter("doc_id IS NOT NULL").groupBy(word.alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("_bits"))
        if words.count() <= MOST_WORDS:
            beside = docs.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
            return beside.withColumn("_t", F.coalesce(F.expr(f"shiftright(_bits, {bit}) & 1L"), F.lit(0))).drop("_word", "_bits")
    ids = trusted.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["_id"], "left").withColumn("_t", F.col("_id").isNotNull().cast("long")).drop("_id")


def grams(flagged: DataFrame) -> DataFrame:
    """(_t, bucket) of each n-gram of the texts of ``flagged`` (_t, text).

    A row is made for each word, with the one after it: there is no lambda function, so all is compiled."""
    pairs = flagged.select("_t", words(F.col("text")).alias("_words"))
    pairs = pairs.select("_t", "_words", F.slice("_words", 2, F.size("_words")).alias("_next")).select("_t", F.inline(F.arrays_zip("_words", "_next")))
    pairs = pairs.select("_t", F.xxhash64("_words").alias("_x"), F.when(F.col("_next").isNotNull(), F.xxhash64("_next")).alias("_y"))
    return pairs.select("_t", F.explode(F.array(bucket(F.col("_x")), pair_bucket(pair(F.col("_x"), F.col("_y"))))).alias("bucket")).filter("bucket IS NOT NULL")


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """The log ratio of each bucket."""
    flagged = with_trust(docs, labels.filter("quality = 1").select("doc_id")).select("_t", "text")
    seen = grams(flagged).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_t").alias("good")).collect()  # BUCKETS rows at most
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in seen:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    n_raw, n_good = sum(raw), sum(good)
    base = [(n + 1.0) / (n_raw + BUCKETS) for n in raw]
    return [round(math.log((g + PRIOR * p) / ((n_good + PRIOR) * p)), 4) for g, p in zip(good, base, strict=True)]


def held_out() -> Column:
    """A tenth of the ids, whose labels are left for the threshold."""
    return F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(10)) == 0


def cut(good: list[float], bad: list[float]) -> float:
    """The score at which the shares of bad ones kept and good ones lost have the smallest sum; of equal ones the lowest."""
    if not good or not bad:
        return THRESHOLD
    good, bad = sorted(good), sorted(bad)
    scores = sorted({*good, *bad})
    between = [scores[0], *[(a + b) / 2 for a, b in pairwise(scores)]]
    return min(between, key=lambda t: (bisect_left(good, t) / len(good) - bisect_left(bad, t) / len(bad), t))


def best_cut(scored: DataFrame) -> float:
    """``cut`` of a table (score, good boolean) of any size, the same to the last bit.

    Different scores are counted, and ranges of them; places are ranked within a range, from what the driver added up of those before."""
    one = F.when(F.col("good"), 1).otherwise(0)
    seen = scored.filter("score IS NOT NULL").groupBy("score").agg(F.sum(one).alias("g"), F.sum(1 - one).alias("b"))
    seen = seen.withColumn("_span", F.floor(F.col("score") / SPAN)).persist()
    try:
        spans = seen.groupBy("_span").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("score").alias("last")).orderBy("_span").collect()
        n_good, n_bad = sum(r["g"] for r in spans), sum(r["b"] for r in spans)
        if not n_good or not n_bad:
            return THRESHOLD
        before, g, b, last = [], 0, 0, None
        for r in spans:
            before.append((r["_span"], g, b, last))
            g, b, last = g + r["g"], b + r["b"], r["last"]
        before = scored.sparkSession.createDataFrame(before, "_span long, _g long, _b long, _last double")
        w = W.partitionBy("_span").orderBy("score")
        lower = w.rowsBetween(W.unboundedPreceding, -1)
        under = lambda column, so_far: F.col(so_far) + F.coalesce(F.sum(column).over(lower), F.lit(0))
        prior = F.coalesce(F.lag("score").over(w), F.col("_last"))
        places = seen.join(F.broadcast(before), "_span").select(
            (under("g", "_g") / F.lit(n_good) - under("b", "_b") / F.lit(n_bad)).alias("loss"), F.when(prior.isNull(), F.col("score")).otherwise((prior + F.col("score")) / 2).alias("at")
        )
        return places.agg(F.min(F.struct("loss", "at")).alias("m")).first()["m"]["at"]
    finally:
        seen.unpersist()


def with_held(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """(score, good) of judged documents whose labels are not trusted and agree."""
    one = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    held = one.filter((F.col("quality") == F.col("_most")) & ((F.col("quality") == 0) | held_out())).select("doc_id", (F.col("quality") == 1).alias("good"))
    return judged.filter(~F.col("base_failed")).select("doc_id", "score").join(held, "doc_id").select("score", "good")


def fitted_threshold(docs: DataFrame, labels: DataFrame, ratios: list[float]) -> float:
    """The threshold by all labelled rows that are not trusted; the ratios must come from good rows that are not held out."""
    return best_cut(with_held(judge(docs, ratios), labels))


def kept(judged: DataFrame, threshold: float) -> DataFrame:
    """Judged documents, with the verdict by a threshold."""
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))


def fitted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``judge`` with ratios and threshold by the labels. Each document is judged once: counts and scores, without the texts, are written and read again."""
    ratios = log_ratios(docs, labels.filter(~held_out()))
    judged = written(judge(docs, ratios), "judged")
    return kept(judged, best_cut(with_held(judged, labels)))


def judge(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, counts, base_failed, score, kept) of each document (doc_id, text)."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded into a literal
    found = counts(docs)
    ones = F.aggregate("_h", F.lit(0.0), lambda a, x: a + F.get(table, bucket(x)))
    both = F.aggregate("_g", ones, lambda a, g: a + F.get(table, pair_bucket(g)))
    found = found.withColumn("score", F.when(F.size("_h") > 0, both / (F.size("_h") + F.size("_g")))).drop("_buckets", "_h", "_g")
    return kept(found, threshold)
