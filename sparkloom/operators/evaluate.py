"""Scoring of found rows against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import normalize_qualified

KEY = ["path", "line", "target"]


def scored(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case, hits, missing, extra, precision, recall) from (case, path, line, target_qualified) rows as sets.

    Without actual rows the precision is 1 if nothing was expected, else 0; without expected ones the recall is 1."""
    key = lambda df, name: df.select("case", "path", "line", normalize_qualified(F.col("target_qualified")).alias("target"), F.lit(1).alias(name)).distinct()
    both = key(expected, "_e").join(key(actual, "_a"), ["case", *KEY], "full_outer")
    e, a = F.coalesce("_e", F.lit(0)), F.coalesce("_a", F.lit(0))
    sums = both.groupBy("case").agg(F.sum(e * a).alias("hits"), F.sum(e * (1 - a)).alias("missing"), F.sum(a * (1 - e)).alias("extra"))
    found, wanted = F.col("hits") + F.col("extra"), F.col("hits") + F.col("missing")
    precision = F.when(found > 0, F.col("hits") / found).otherwise(F.when(wanted > 0, 0.0).otherwise(1.0))
    recall = F.when(wanted > 0, F.col("hits") / wanted).otherwise(1.0)
    return sums.withColumns({"precision": precision, "recall": recall})


def by_language(scores: DataFrame, cases: DataFrame) -> DataFrame:
    """Average precision and recall of each language's cases (case, language)."""
    return scores.join(cases, "case").groupBy("language").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("cases"))


def missing_and_extra(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows on one side only, with that side."""
    missing = expected.exceptAll(actual).withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.exceptAll(expected).withColumn("side", F.lit("extra")))


def medians(samples: DataFrame) -> DataFrame:
    """Median milliseconds of each operation's samples (operation, ms)."""
    return samples.groupBy("operation").agg(F.median("ms").alias("ms"))
