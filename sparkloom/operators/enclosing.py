"""Interval joins: the smallest symbol around a byte range or a line. Always keyed by blob and parser first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CALLABLE = ("function", "method", "test")


def enclosing_by_bytes(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """``sites`` (id, blob_sha, parser_id, byte_start, byte_end) with the smallest function, method or test around each."""
    s = symbols.filter(F.col("kind").isin(*CALLABLE)).select(
        "blob_sha", "parser_id", F.col("id").alias("enclosing"), F.col("byte_start").alias("_a"), F.col("byte_end").alias("_b")
    )
    inside = (F.col("_a") <= F.col("byte_start")) & (F.col("_b") >= F.col("byte_end"))
    around = sites.join(s, ["blob_sha", "parser_id"]).filter(inside)
    # the smallest by one aggregate: no sort, and pre-aggregated before the shuffle
    best = around.groupBy("id").agg(F.min(F.struct((F.col("_b") - F.col("_a")).alias("span"), F.col("enclosing"))).alias("_m"))
    return sites.join(best, "id", "left").select(*sites.columns, "_m.enclosing")


def enclosing_by_line(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """``sites`` (id, blob_sha, line) with the symbol around each line: smallest span, then latest start, then id.

    Each line of a blob is looked up once, whatever the number of sites on it."""
    s = symbols.select("blob_sha", F.col("id").alias("enclosing"), F.col("line_start").alias("_a"), F.col("line_end").alias("_b"))
    lines = sites.select("blob_sha", "line").distinct()
    around = lines.join(s, "blob_sha").filter((F.col("_a") <= F.col("line")) & (F.col("_b") >= F.col("line")))
    best = around.groupBy("blob_sha", "line").agg(F.min(F.struct((F.col("_b") - F.col("_a")).alias("span"), (-F.col("_a")).alias("late"), F.col("enclosing"))).alias("_m"))
    return sites.join(best, ["blob_sha", "line"], "left").select(*sites.columns, "_m.enclosing")


def path_of_symbol(symbols: DataFrame, entries: DataFrame, manifest_id: int) -> DataFrame:
    """(id, path): of a symbol's paths in a manifest the smallest."""
    here = entries.filter(F.col("manifest_id") == manifest_id)
    per_blob = here.groupBy("blob_sha").agg(F.min("path").alias("path"))
    return symbols.join(per_blob, "blob_sha").select("id", "path")


def smallest_by_span(symbols: DataFrame, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.col("byte_end") - F.col("byte_start"), "id")
    return symbols.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
