"""Provenance of facts: ranks of sources, workspace tiers and the best resolution of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: kind_source of a fact that no resolution covers.
FACT = "tier2-fact"
RESOLVED_KINDS = ("type", "call", "import")
SITE = ["site_blob_sha", "site_parser_id", "site_byte_start", "site_byte_end"]


def source_rank(source: Column) -> Column:
    """0 for language servers, then in-process cross-file passes, grammar-implied rows, native enrichers, the rest."""
    ranks = F.when(source.startswith("tier3-"), 0).when(source.startswith("tier25-"), 1)
    return ranks.when(source.startswith("tier2-direct-"), 2).when(source == "rust-syn", 3).otherwise(4)


def is_workspace_tier(source: Column) -> Column:
    return source.startswith("tier3-") | source.startswith("tier25-")


def best_resolution(resolutions: DataFrame, manifest_id: int, kinds: tuple[str, ...] = RESOLVED_KINDS, by_kind: bool = True, sites: DataFrame | None = None) -> DataFrame:
    """One resolution per site (and kind): the manifest's own before manifest-free ones, then by source rank, then id.

    The manifest and kind filters are pushed to the scan; the rank-1 filter becomes a group limit below the shuffle. Where only some
    sites (their columns, and kind) are asked for, the others go before anything is ranked: few of them are broadcast, many meet on the keys that ranking needs anyway."""
    seen = resolutions.filter(F.col("kind").isin(*kinds) & ((F.col("manifest_id") == manifest_id) | F.col("manifest_id").isNull()))
    keys = [*SITE, "kind"] if by_kind else SITE
    if sites is not None:
        seen = seen.join(sites.select(*keys), keys, "left_semi")
    order = [F.when(F.col("manifest_id") == manifest_id, 0).otherwise(1), source_rank(F.col("source")), "id"]
    ranked = seen.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")
