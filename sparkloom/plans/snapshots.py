"""Snapshots: anchors, manifests and what is visible in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

class AnchorNotFound(LookupError):
    pass


def default_anchor(anchors: DataFrame, anchor: str | None = None, branch: str | None = None) -> str:
    """An explicit anchor, else the branch's, else the first tentative one in string order, else HEAD."""
    if anchor is not None:
        return anchor
    if branch is not None:
        return f"branch/{branch}"
    first = anchors.filter(F.col("anchor_name").startswith("tentative/")).agg(F.min("anchor_name")).first()[0]
    return first or "HEAD"


def resolve(anchors: DataFrame, anchor: str) -> int:
    """The manifest an anchor names: read once, then a literal in every filter, so that one query sees one snapshot."""
    found = anchors.filter(F.col("anchor_name") == anchor).select("manifest_id").first()
    if found is None:
        raise AnchorNotFound(anchor)
    return found[0]


def upsert_anchor(anchors: DataFrame, name: str, manifest_id: int, now_ns: int, generation: int | None = None) -> DataFrame:
    row = anchors.sparkSession.createDataFrame([(name, manifest_id, now_ns, generation)], anchors.schema)
    return delete_anchor(anchors, name).unionByName(row)


def delete_anchor(anchors: DataFrame, name: str) -> DataFrame:
    return anchors.filter(F.col("anchor_name") != name)


def anchors_with_prefix(anchors: DataFrame, prefix: str) -> DataFrame:
    return anchors.filter(F.col("anchor_name").startswith(prefix)).orderBy("anchor_name")


def entries_of(entries: DataFrame, manifest_id: int) -> DataFrame:
    """(path, blob_sha) of a manifest; the filter prunes the scan."""
    return entries.filter(F.col("manifest_id") == manifest_id).select("path", "blob_sha")


def upsert_entries(entries: DataFrame, changed: DataFrame) -> DataFrame:
    """Replace paths of manifests by ``changed`` (manifest_id, path, blob_sha); a null blob deletes."""
    kept = entries.join(changed.select("manifest_id", "path"), ["manifest_id", "path"], "left_anti")
    return kept.unionByName(changed.filter("blob_sha IS NOT NULL"))


def same_manifest(entries: DataFrame, a: int, b: int) -> bool:
    """Whether two manifests hold equal entries."""
    x, y = entries_of(entries, a), entries_of(entries, b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def live_facts(facts: DataFrame, blobs: DataFrame) -> DataFrame:
    """Facts whose blob was not deleted: the cascade of a blob's deletion."""
    return facts.join(blobs.select("blob_sha", "parser_id"), ["blob_sha", "parser_id"], "left_semi")
