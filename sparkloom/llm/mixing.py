"""Mixing sources to target weights.

``source_rates`` aggregates the tokens (words) of each source and derives its repetition rate;
``mix`` then emits each document floor(rate) times, and once more when a hash of seed and document
id, read as a number in [0, 1), is below the rate's fraction.

Targets: all sources together get ``total_share`` times the corpus' size, dealt by weight. A
target stops at ``max_rate`` times its source's size; the excess is dealt again by weight among the
others until none is above. The closed form used here sorts the sources by max_rate * size /
weight; those whose ratio is at most the final level are capped. Weights repeat over
the sources in code-point order, with the null source last.

Cases: a null text has size 0; a null source is a source of its own; a source of size 0 has target 0
and rate 0; a row without a doc_id is drawn by its text; rows that repeat a doc_id, or without one a text, are drawn alike.
An empty table gives an empty result. Columns that clash with the result's are replaced.
Only per-source totals are gathered; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, n_words

WEIGHTS = (3, 1, 2)
TOTAL_SHARE, MAX_RATE, SEED = 1.5, 2.0, "mix-1"
#: Per-source rows that are broadcast at most; with more sources the join shuffles.
MAX_BROADCAST_SOURCES = 20_000


def source_rates(docs: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, target, rate) of each source."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source: a window over all of them is small
    by_name = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    k = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k + 1).cast("int"))
    level = W.orderBy("ratio", F.col("source").isNull(), "source")
    sizes = (
        sizes.withColumn("w", w)
        .withColumn("ratio", F.lit(max_rate) * F.col("source_size") / F.col("w"))
        .withColumn("before", F.coalesce(F.sum(F.lit(max_rate) * F.col("source_size")).over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("due", F.lit(total_share) * F.sum("source_size").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("capped", F.col("ratio") * F.col("w_left") <= F.col("due") - F.col("before"))
    )
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    taken = F.sum(F.when(F.col("capped"), F.lit(max_rate) * F.col("source_size")).otherwise(0.0)).over(every)
    left = F.sum(F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("w"))).over(every)
    target = F.when(F.col("capped"), F.lit(max_rate) * F.col("source_size")).otherwise((F.col("due") - taken) * F.col("w") / left)
    return sizes.withColumn("target", target).select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def draw(doc_id, text, seed: str = SEED) -> F.Column:
    """A number in [0, 1) from 52 bits of the hash of seed and id, or of the text where there is no id."""
    own = F.concat(F.lit("-"), F.md5(F.coalesce(text, F.lit(""))))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), own))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def with_copies(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """Each document with size, source_size, target and copies (how often it is emitted)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "source_size", "target", "rate", "copies")])
    docs = docs.withColumn("size", n_words(F.col("text")))
    rates = cut(source_rates(docs.select("source", "size"), **how), "rates")
    rates = rates.withColumnRenamed("source", "_source")
    if rates.count() <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = docs.join(rates, docs["source"].eqNullSafe(rates["_source"]), "left").drop("_source")
    whole = F.floor("rate")
    copies = whole + F.when(draw(F.col("doc_id"), F.col("text"), seed) < F.col("rate") - whole, 1).otherwise(0)
    return joined.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("int")).drop("rate")


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The mixed corpus: the documents' own columns, each row as often as it was drawn."""
    drawn = with_copies(docs.select("doc_id", "source", "text", F.struct("*").alias("_row")), seed, **how)
    return drawn.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("_row.*")
