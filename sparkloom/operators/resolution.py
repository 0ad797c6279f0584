"""From an analyzer's targets to resolution rows: a lookup cascade with uniqueness checks.

A target names a path, a qualified name, or both. Legal results are (path, symbol), (path, none) and (none, none).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.enclosing import enclosing_by_bytes, path_of_symbol, smallest_by_span


def resolve_targets(sites: DataFrame, symbols: DataFrame, entries: DataFrame, manifest_id: int, parser_id: str) -> DataFrame:
    """``sites`` (id, kind, target_path, target_qualified) with resolved_path and target_symbol_id.

    A path outside the manifest blocks every lookup. With a path: the parser's own symbol of that name (smallest span),
    else the file's only one of any parser. Without a path, and not for imports: the manifest's only one, whose
    smallest path is then the target's."""
    here = entries.filter(F.col("manifest_id") == manifest_id)
    files = here.select(F.col("path").alias("target_path"), F.col("blob_sha").alias("_blob"))
    s = sites.join(files, "target_path", "left")
    named = symbols.select(F.col("blob_sha").alias("_blob"), F.col("qualified").alias("target_qualified"), F.col("id").alias("_id"), "parser_id", "byte_start", "byte_end")
    own = smallest_by_span(symbols.filter(F.col("parser_id") == parser_id), ["blob_sha", "qualified"])
    own = own.select(F.col("blob_sha").alias("_blob"), F.col("qualified").alias("target_qualified"), F.col("id").alias("_own"))
    in_file = named.groupBy("_blob", "target_qualified").agg(F.count(F.lit(1)).alias("_n_file"), F.min("_id").alias("_file"))
    visible = symbols.join(here.select("blob_sha").distinct(), "blob_sha", "left_semi")
    in_all = visible.groupBy(F.col("qualified").alias("target_qualified")).agg(F.count(F.lit(1)).alias("_n_all"), F.min("id").alias("_all"))
    s = s.join(own, ["_blob", "target_qualified"], "left").join(in_file, ["_blob", "target_qualified"], "left").join(in_all, "target_qualified", "left")
    has_path, known = F.col("target_path").isNotNull(), F.col("_blob").isNotNull()
    by_file = F.coalesce("_own", F.when(F.col("_n_file") == 1, F.col("_file")))
    by_all = F.when((F.col("kind") != "import") & (F.col("_n_all") == 1), F.col("_all"))
    s = s.withColumn("_symbol", F.when(has_path & known, by_file).when(~has_path, by_all))
    paths = path_of_symbol(symbols, entries, manifest_id).withColumnRenamed("id", "_symbol").withColumnRenamed("path", "_derived")
    s = s.join(paths, "_symbol", "left")
    path = F.when(has_path & known, F.col("target_path")).when(~has_path, F.col("_derived"))
    symbol = F.when(has_path & known, F.col("_symbol")).when(~has_path & F.col("_derived").isNotNull(), F.col("_symbol"))
    return s.select(*[c for c in sites.columns], path.alias("resolved_path"), symbol.alias("target_symbol_id"))


def replace_resolutions(resolutions: DataFrame, entries: DataFrame, new: DataFrame, manifest_id: int, source: str) -> DataFrame:
    """All resolutions after one source wrote its rows for a manifest: its older rows there go, and its manifest-free ones of that manifest's blobs."""
    blobs = entries.filter(F.col("manifest_id") == manifest_id).select(F.col("blob_sha").alias("site_blob_sha")).distinct()
    mine = resolutions.filter(F.col("source") == source)
    others = resolutions.filter(F.col("source") != source)
    kept = mine.filter((F.col("manifest_id") != manifest_id) & F.col("manifest_id").isNotNull())
    free = mine.filter("manifest_id IS NULL").join(blobs, "site_blob_sha", "left_anti")
    return others.unionByName(kept).unionByName(free.select(*others.columns)).unionByName(new)


def server_references(found: DataFrame, symbols: DataFrame, entries: DataFrame, manifest_id: int) -> DataFrame:
    """References from a language server's definitions (id, blob_sha, parser_id, byte_start, byte_end, kind, target_path,
    target_line): only those with a target in the manifest and a symbol there; an import without a symbol targets its file."""
    here = entries.filter(F.col("manifest_id") == manifest_id).select(F.col("path").alias("target_path"), F.col("blob_sha").alias("_blob"))
    at = found.join(here, "target_path")
    lines = symbols.select(F.col("blob_sha").alias("_blob"), F.col("id").alias("_id"), "qualified", F.col("line_start").alias("_a"), F.col("line_end").alias("_b"))
    around = at.select("id", "_blob", "target_line").join(lines, "_blob").filter((F.col("_a") <= F.col("target_line")) & (F.col("_b") >= F.col("target_line")))
    best = around.groupBy("id").agg(F.min(F.struct((F.col("_b") - F.col("_a")).alias("span"), (-F.col("_a")).alias("late"), F.col("_id").alias("sym"), F.col("qualified"))).alias("_m"))
    at = at.join(best, "id", "left").filter(F.col("_m").isNotNull() | (F.col("kind") == "import"))
    at = at.select(*found.columns, F.col("_m.sym").alias("target_symbol_id"), F.col("_m.qualified").alias("target_qualified"))
    return enclosing_by_bytes(at, symbols)


#: What a grammar's shape says for sure, by language: fixed values (language, shape, meaning).
DIRECT = [
    ("java", "extends", "inherit"), ("java", "implements", "implement"),
    ("typescript", "extends", "inherit"), ("typescript", "implements", "implement"),
    ("javascript", "extends", "inherit"),
    ("php", "extends", "inherit"), ("php", "implements", "implement"), ("php", "trait_use", "mixin"),
    ("ruby", "less_than", "inherit"), ("ruby", "include", "mixin"), ("ruby", "extend", "mixin"), ("ruby", "prepend", "mixin"),
    ("rust", "impl_for", "implement"),
    ("cpp", "public_base", "inherit"), ("cpp", "private_base", "inherit"), ("cpp", "protected_base", "inherit"),
    ("objc", "interface_colon", "inherit"), ("objc", "protocol_list", "implement"), ("objc", "category", "extension"),
    ("swift", "extension", "extension"),
]


def direct_resolutions(implementations: DataFrame, language) -> DataFrame:
    """Manifest-free resolutions that a grammar's shape implies, for rows with a byte range. language: a column of parser_id."""
    spark = implementations.sparkSession
    rules = spark.createDataFrame(DIRECT, "_language string, syntactic_kind string, semantic_kind string")
    rows = implementations.filter("interface_byte_start IS NOT NULL AND interface_byte_end IS NOT NULL").withColumn("_language", language)
    found = rows.join(F.broadcast(rules), ["_language", "syntactic_kind"])
    return found.select(
        "id", F.col("blob_sha").alias("site_blob_sha"), F.col("parser_id").alias("site_parser_id"), F.col("interface_byte_start").alias("site_byte_start"), F.col("interface_byte_end").alias("site_byte_end"),
        F.lit("type").alias("kind"), "semantic_kind", F.lit(None).cast("long").alias("target_symbol_id"), F.concat(F.lit("tier2-direct-"), F.col("_language")).alias("source"),
        F.lit(None).cast("string").alias("target_path"), F.lit(None).cast("long").alias("manifest_id"),
    )
