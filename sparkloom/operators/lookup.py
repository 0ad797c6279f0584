"""The query verbs over one snapshot. Each returns a DataFrame, ordered and limited like its contract says.

A snapshot is a manifest id; file lists, symbols, references and resolutions are DataFrames. Every limit has a full
tie-break, so results do not depend on partitioning. Sort and limit become one top-k per partition.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import fts, text
from sparkloom.functions.provenance import FACT, SITE, best_resolution, is_workspace_tier, source_rank
from sparkloom.plans.layouts import at_keys, few_keys, second
from sparkloom.plans.snapshots import entries_of
from sparkloom.sources.shared import written

SOURCE_CANDIDATES = 20


def find_symbols(facts, manifest_id: int, query: str | None = None, fuzzy: bool = False, kind: str | None = None, container: str | None = None, path: str | None = None, limit: int | None = None) -> DataFrame:
    """Top-level symbols by name or qualified name (or full-text), kind, container and path prefix."""
    query, kind, container, path = (x or None for x in (query, kind, container, path))  # an empty one filters nothing
    if query is None and kind is None and container is None and path is None:
        raise ValueError("one of query, kind, container and path is needed")
    found = _symbols(facts, entries_of(facts.manifest_entries, manifest_id), query, fuzzy, kind, container, path)
    return found.orderBy(*_symbol_order()).limit(max(1, limit if limit is not None else 50))


def _symbol_order(*after_line: str) -> list:
    return [F.col("language").asc_nulls_last(), "path", "line_start", *after_line, "qualified", "parser_id"]


def _symbols(facts, entries: DataFrame, query: str | None, fuzzy: bool, kind: str | None, container: str | None, path: str | None, *more: str) -> DataFrame:
    """Top-level symbols in the files ``entries``, with further columns of these."""
    if query is None:
        s = facts.symbols
    elif fuzzy:
        s = facts.symbols.join(fts.search(second(facts, "postings"), query), "id", "left_semi")
    else:  # each of the two names is looked up in its own order
        other = second(facts, "symbols_by_name").filter((F.col("name") == query) & (F.col("qualified").isNull() | (F.col("qualified") != query)))
        s = facts.symbols.filter(F.col("qualified") == query).unionByName(other)
    s = s.filter("scope = 'top_level'")
    if kind is not None:
        s = s.filter(F.col("kind") == kind)
    if container is not None:
        s = s.filter(text.like_prefix(F.col("qualified"), f"{container}::") | text.like_prefix(F.col("qualified"), f"{container}."))
    if path is not None:
        entries = entries.filter(text.like_prefix(F.col("path"), path))
    # blobs are joined by content alone: content that two parsers read gives a row for each
    blobs = facts.blobs.select("blob_sha", F.when(F.col("analyzer_id").isNotNull(), text.language_of(F.col("parser_id"))).alias("language"))
    found = s.join(entries, "blob_sha").join(blobs, "blob_sha")
    return found.select(*more, "name", "qualified", "kind", "signature", "visibility", "doc", "path", "line_start", "line_end", "blob_sha", "parser_id", "language")


def find_symbols_over(facts, targets: DataFrame, query: str | None = None, fuzzy: bool = False, kind: str | None = None, container: str | None = None, path: str | None = None, limit: int = 50) -> DataFrame:
    """``find_symbols`` in many repositories, given as rows (alias, manifest_id): each gives its first rows, of which the first in all are kept.

    One plan, whatever the number of repositories: symbols are filtered and joined once for all manifests."""
    query, kind, container, path = (x or None for x in (query, kind, container, path))
    if query is None and kind is None and container is None and path is None:
        raise ValueError("one of query, kind, container and path is needed")
    entries = facts.manifest_entries.join(targets.select("alias", "manifest_id"), "manifest_id").select("alias", "path", "blob_sha")
    found = _symbols(facts, entries, query, fuzzy, kind, container, path, "alias")
    first = F.row_number().over(W.partitionBy("alias").orderBy(*_symbol_order()))
    limit = max(1, limit)
    return found.withColumn("_k", first).filter(F.col("_k") <= limit).drop("_k").orderBy(*_symbol_order("alias"), "name", "blob_sha").limit(limit)


def _sites(facts: DataFrame, start: str, end: str, *more: str) -> DataFrame:
    """The sites of facts, with the names that resolutions give them."""
    columns = ("blob_sha", "parser_id", start, end)
    return facts.filter(F.col(start).isNotNull()).select(*[F.col(c).alias(s) for c, s in zip(columns, SITE, strict=True)], *more)


def _implementations(facts, manifest_id: int, column: str, value: str, limit: int) -> DataFrame:
    i = facts.implementations.filter(F.col(column) == value).join(entries_of(facts.manifest_entries, manifest_id), "blob_sha")
    # resolutions neither add nor drop rows: only what is within the limit is resolved
    i, few = _first(i.orderBy("path", "line", "id"), limit)
    sites = _sites(i, "interface_byte_start", "interface_byte_end")
    best = best_resolution(facts.resolutions, manifest_id, ("type",), by_kind=False, sites=F.broadcast(sites) if few else sites)
    best = best.select(*SITE, "semantic_kind", F.col("source").alias("_source"), "target_path")
    site = (i["blob_sha"] == best["site_blob_sha"]) & (i["parser_id"] == best["site_parser_id"])
    site &= (i["interface_byte_start"] == best["site_byte_start"]) & (i["interface_byte_end"] == best["site_byte_end"])
    found = i.join(best, site, "left").select(
        "type_qualified",
        "interface_qualified",
        F.coalesce("semantic_kind", "kind").alias("kind"),
        F.coalesce("_source", F.lit(FACT)).alias("kind_source"),
        "path",
        "line",
        "blob_sha",
        "parser_id",
        "target_path",
        F.col("id").alias("_id"),
    )
    return found.orderBy("path", "line", "_id").drop("_id")


def find_subtypes(facts, manifest_id: int, name: str, limit: int = 100) -> DataFrame:
    """Types whose interface is exactly ``name``, one hop."""
    return _implementations(facts, manifest_id, "interface_qualified", name, limit)


def find_supertypes(facts, manifest_id: int, name: str, limit: int = 100) -> DataFrame:
    """Interfaces of exactly the type ``name``, one hop."""
    return _implementations(facts, manifest_id, "type_qualified", name, limit)


def find_imports(facts, manifest_id: int, file: str | None = None, limit: int | None = None) -> DataFrame:
    entries = entries_of(facts.manifest_entries, manifest_id)
    if file is not None:
        entries = entries.filter(F.col("path") == file)
    i, few = _first(facts.imports.join(entries, "blob_sha").orderBy("path", "line", "id"), limit if limit is not None else 200)
    sites = _sites(i, "byte_start", "byte_end")
    best = best_resolution(facts.resolutions, manifest_id, ("import",), by_kind=False, sites=F.broadcast(sites) if few else sites)
    best = best.select(*SITE, F.col("source").alias("_source"), "target_path")
    site = (i["blob_sha"] == best["site_blob_sha"]) & (i["parser_id"] == best["site_parser_id"])
    site &= (i["byte_start"] == best["site_byte_start"]) & (i["byte_end"] == best["site_byte_end"])
    found = i.join(best, site, "left").select(
        "path", "to_module", "imported", "alias", "is_reexport", "line", "target_path", F.coalesce("_source", F.lit(FACT)).alias("kind_source"), "blob_sha", "parser_id", F.col("id").alias("_id")
    )
    return found.orderBy("path", "line", "_id").drop("_id")


def _workspace_lines(refs: DataFrame) -> DataFrame:
    """Lines, kinds and targets that a workspace tier has a reference for."""
    keys = ["blob_sha", "line", "kind", "target_name", "enclosing_id"]
    return refs.filter(is_workspace_tier(F.col("source"))).select(*[F.col(c).alias(f"_w_{c}") for c in keys], F.lit(True).alias("_shadowed"))


#: Rows of a lookup that are kept at hand and broadcast at most, and how many lookups' rows are kept.
FEW_ROWS, LOOKUPS = 50_000, 16
#: Of each session: the rows that its latest lookups keep.
_HELD: WeakKeyDictionary = WeakKeyDictionary()


def _few(df: DataFrame) -> tuple[DataFrame, bool]:
    """The rows, and whether they are few. Few rows are kept in the executors, so that the joins that follow know their size and
    do not look them up again; those of older lookups are let go."""
    few = df.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    return (_held(df), True) if few else (df, False)


def _first(ordered: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The rows within a limit, and whether that makes them few: those are looked up once and kept."""
    df = ordered.limit(max(1, limit))
    return (_held(df), True) if limit <= FEW_ROWS else (df, False)


def _held(df: DataFrame) -> DataFrame:
    """Few rows, kept in the executors."""
    df = df.persist()
    df.count()
    held = _HELD.setdefault(df.sparkSession, deque())
    held.append(df)
    while len(held) > 3 * LOOKUPS:
        held.popleft().unpersist()
    return df


def release(spark: SparkSession) -> None:
    """Let go of the rows that a session's lookups keep; their results can still be read, and are looked up again then."""
    for df in _HELD.pop(spark, ()):
        df.unpersist()


def _without_noise(facts, r: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """One reference per range and kind, and none without a range that a workspace tier's reference on its line stands for.

    Only references without a range can be shadowed: the lines of their contents alone are looked up."""
    empty = F.when(F.col("target_qualified").isNotNull() & (F.col("target_qualified") != ""), 0).otherwise(1)
    w = W.partitionBy(*keys, "blob_sha", "byte_start", "byte_end", "kind").orderBy("source_rank", empty, "source", "path", "id")
    refs = facts.refs
    if few:
        bare = r.filter((F.col("byte_start") == 0) & (F.col("byte_end") == 0) & (F.col("source_rank") > 0)).select("blob_sha")
        blobs = few_keys(bare, "blob_sha")
        refs = facts.refs.join(F.broadcast(bare.distinct()), "blob_sha", "left_semi") if blobs is None else at_keys(second(facts, "refs_by_blob"), "blob_sha", blobs)
    lines = _workspace_lines(refs)
    r = r.withColumn("_dup", F.row_number().over(w)).filter("_dup = 1").drop("_dup")
    same = (r["blob_sha"] == lines["_w_blob_sha"]) & (r["line"] == lines["_w_line"]) & (r["kind"] == lines["_w_kind"])
    same &= (r["target_name"] == lines["_w_target_name"]) & r["enclosing_id"].eqNullSafe(lines["_w_enclosing_id"])
    same &= r["source_rank"] > 0
    # only rows without a range can be shadowed; the others are not shuffled for the join
    bare = F.coalesce((F.col("byte_start") == 0) & (F.col("byte_end") == 0), F.lit(False))
    return r.filter(~bare).unionByName(r.filter(bare).join(lines, same, "left_anti"))


def _resolved(facts, manifest_id: int, r: DataFrame, few: bool) -> DataFrame:
    """References with their best resolution and its symbol's name, and the name of the symbol around them.

    few: there are few of them (their number is known), so that larger tables are filtered before anything is shuffled."""
    sites = _sites(r, "byte_start", "byte_end", "kind")
    resolutions = at_keys(facts.resolutions, "site_blob_sha", few_keys(r, "blob_sha")) if few else facts.resolutions
    best = best_resolution(resolutions, manifest_id, sites=F.broadcast(sites) if few else sites)
    best = best.select(*SITE, F.col("kind").alias("_rkind"), F.col("source").alias("_rsource"), "target_path", "target_symbol_id")
    names = facts.symbols.select("id", "qualified")
    if few:
        best = _held(best)
        ids = best.select(F.col("target_symbol_id").alias("id")).unionByName(r.select(F.col("enclosing_id").alias("id")))
        keys = few_keys(ids, "id")
        names = names.join(F.broadcast(ids.filter("id IS NOT NULL").distinct()), "id", "left_semi") if keys is None else at_keys(second(facts, "symbols_by_id"), "id", keys).select("id", "qualified")
    site = (r["blob_sha"] == best["site_blob_sha"]) & (r["parser_id"] == best["site_parser_id"])
    site &= (r["byte_start"] == best["site_byte_start"]) & (r["byte_end"] == best["site_byte_end"]) & (r["kind"] == best["_rkind"])
    r = r.join(best, site, "left").join(names.select(F.col("id").alias("target_symbol_id"), F.col("qualified").alias("_resolved")), "target_symbol_id", "left")
    if "enclosing" in r.columns:
        return r
    return r.join(names.select(F.col("id").alias("enclosing_id"), F.col("qualified").alias("enclosing")), "enclosing_id", "left")


def _references(facts, manifest_id: int, refs: DataFrame, outgoing: bool, include_noise: bool, keys: list[str], within: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The join chain that all reference queries share; ``refs`` are already filtered where the filter needs no join.

    keys: extra columns (of batched lookups) within which duplicates are looked for; within: the limit, if it does not depend on what
    references resolve to, so that only rows within it are resolved; without ``keys`` it leaves ``FEW_ROWS`` at most."""
    r = refs.join(entries_of(facts.manifest_entries, manifest_id), "blob_sha").withColumn("source_rank", source_rank(F.col("source")))
    if outgoing and not include_noise:
        r, few = _few(r)
        r = _resolved(facts, manifest_id, r, few)
        own = F.col("target_qualified").isNotNull() & (F.col("target_qualified") != "")
        r = _without_noise(facts, r.filter(own | F.col("_resolved").isNotNull()), keys, few)
    else:
        r, few = (r, False) if keys else _few(r)
        r = r if include_noise else _without_noise(facts, r, keys, few)
        if within is not None and keys:  # steps that follow read what is left, instead of finding it again
            r, few = _few(written(within(r), "within"))
        elif within is not None:
            r, few = _held(within(r)), True
        elif few:
            r = _held(r)
        r = _resolved(facts, manifest_id, r, few)
    return r.select(
        *keys,
        "target_name",
        F.coalesce("_resolved", "target_qualified").alias("target_qualified"),
        "kind",
        "enclosing",
        "path",
        "line",
        "blob_sha",
        "parser_id",
        F.coalesce("_rsource", F.lit(FACT)).alias("kind_source"),
        "target_path",
        F.col("byte_start").alias("_start"),
        F.col("source_rank").alias("_rank"),
        F.col("id").alias("_id"),
    )


ORDER = ["path", "line", "byte_start", "source_rank", "id"]


def _ordered(r: DataFrame, limit: int) -> DataFrame:
    return r.orderBy("path", "line", "_start", "_rank", "_id").limit(max(1, limit)).drop("_start", "_rank", "_id")


def references_by_name(facts, manifest_id: int, name: str, kind: str | None = None, include_noise: bool = False, limit: int = 100) -> DataFrame:
    """References whose bare target name is ``name``."""
    refs = facts.refs.filter(F.col("target_name") == name)
    refs = refs if kind is None else refs.filter(F.col("kind") == kind)
    within = (lambda r: r.orderBy(*ORDER).limit(max(1, limit))) if limit <= FEW_ROWS else None
    return _ordered(_references(facts, manifest_id, refs, False, include_noise, [], within), limit)


def references_strict(facts, manifest_id: int, symbol: str, kind: str | None = None, include_noise: bool = False, limit: int = 100) -> DataFrame:
    """References whose resolved (else syntactic) target is ``symbol``: two disjoint branches, each filtered at its scan."""
    by_text = second(facts, "refs_by_target").filter(F.col("target_qualified") == symbol)
    own = facts.symbols.filter(F.col("qualified") == symbol).select(F.col("id").alias("target_symbol_id"))
    # only sites that some resolution aims at the symbol are ranked
    keys = few_keys(own, "target_symbol_id")
    sites = facts.resolutions.join(own, "target_symbol_id", "left_semi") if keys is None else at_keys(second(facts, "resolutions_by_target"), "target_symbol_id", keys)
    sites, few = _few(sites.select(*SITE, "kind"))
    blobs = few_keys(sites, "site_blob_sha") if few else None
    resolutions = at_keys(facts.resolutions, "site_blob_sha", blobs)
    best = best_resolution(resolutions, manifest_id, sites=F.broadcast(sites) if few else sites).select(*SITE, F.col("kind").alias("_k"), "target_symbol_id")
    aimed = best.join(own, "target_symbol_id")
    others = facts.refs if blobs is None else at_keys(second(facts, "refs_by_blob"), "blob_sha", blobs)
    others = others.filter(F.col("target_qualified").isNull() | (F.col("target_qualified") != symbol))
    site = (others["blob_sha"] == aimed["site_blob_sha"]) & (others["parser_id"] == aimed["site_parser_id"])
    site &= (others["byte_start"] == aimed["site_byte_start"]) & (others["byte_end"] == aimed["site_byte_end"]) & (others["kind"] == aimed["_k"])
    refs = by_text.unionByName(others.join(F.broadcast(aimed) if few else aimed, site, "left_semi"))
    refs = refs if kind is None else refs.filter(F.col("kind") == kind)
    found = _references(facts, manifest_id, refs, False, include_noise, [])
    return _ordered(found.filter(F.col("target_qualified") == symbol), limit)


def references_outgoing(facts, manifest_id: int, symbol: str, kind: str | None = None, include_noise: bool = False, limit: int = 100) -> DataFrame:
    """References made within the symbol ``symbol``. Without noise these are the resolved ones, and only calls unless a kind is asked for."""
    if kind is None and not include_noise:
        kind = "call"
    enclosing = facts.symbols.filter(F.col("qualified") == symbol).select(F.col("id").alias("enclosing_id"), F.col("qualified").alias("enclosing"))
    keys = few_keys(enclosing, "enclosing_id")
    refs = facts.refs if keys is None else at_keys(second(facts, "refs_by_enclosing"), "enclosing_id", keys)
    enclosing, few = _few(enclosing)
    refs = refs.join(F.broadcast(enclosing) if few else enclosing, "enclosing_id")
    refs = refs if kind is None else refs.filter(F.col("kind") == kind)
    return _ordered(_references(facts, manifest_id, refs, True, include_noise, []), limit)


def find_references(facts, manifest_id: int, symbol: str, direction: str = "incoming", kind: str | None = None, include_noise: bool = False, limit: int = 100) -> DataFrame:
    """Incoming (strict for qualified names, else and if that is empty by bare name) or outgoing references."""
    if not symbol.strip():
        raise ValueError("symbol must not be empty")
    if direction == "outgoing":
        return references_outgoing(facts, manifest_id, symbol, kind, include_noise, limit)
    if text.is_qualified(symbol):
        strict = references_strict(facts, manifest_id, symbol, kind, include_noise, limit)
        if not strict.isEmpty():
            return strict
        symbol = text.bare_name(symbol)
    return references_by_name(facts, manifest_id, symbol, kind, include_noise, limit)


def find_callers(facts, manifest_id: int, name: str, limit: int = 100) -> DataFrame:
    return find_references(facts, manifest_id, name, "incoming", "call", False, limit)


def caller_hint(facts, manifest_id: int, name: str) -> str | None:
    """For an upper-case name without callers that a .tsx or .jsx file defines."""
    if not name[:1].isupper():
        return None
    defined = facts.symbols.filter((F.col("name") == name) | (F.col("qualified") == name)).join(entries_of(facts.manifest_entries, manifest_id), "blob_sha")
    return None if defined.filter(F.col("path").rlike(r"\.[tj]sx$")).isEmpty() else "this looks like a component: ask for references of kind instantiate"


def find_callees(facts, manifest_id: int, name: str, limit: int = 100) -> DataFrame:
    return find_references(facts, manifest_id, name, "outgoing", "call", False, limit)


def find_references_many(facts, manifest_id: int, names: DataFrame, kind: str | None = None, include_noise: bool = False, limit: int = 100) -> DataFrame:
    """Bare-name references of many names (name) in one job: the lookup as a join, the limit per name."""
    wanted = names.select(F.col("name").alias("wanted")).distinct()
    # many rows may share a name, so few names are broadcast
    refs = facts.refs.join(wanted if few_keys(wanted, "wanted") is None else F.broadcast(wanted), F.col("target_name") == F.col("wanted"))
    refs = refs if kind is None else refs.filter(F.col("kind") == kind)
    ranked = lambda r, order: r.withColumn("rank", F.row_number().over(W.partitionBy("wanted").orderBy(*order))).filter(F.col("rank") <= limit)
    found = _references(facts, manifest_id, refs, False, include_noise, ["wanted"], lambda r: ranked(r, ORDER).drop("rank"))
    return ranked(found, ["path", "line", "_start", "_rank", "_id"]).drop("_start", "_rank", "_id")


def get_outline(facts, manifest_id: int, file: str, parser_id: str | None = None, kind: str | None = None) -> DataFrame:
    """All symbols of a file, nested ones too."""
    s = facts.symbols.join(entries_of(facts.manifest_entries, manifest_id).filter(F.col("path") == file), "blob_sha")
    for column, value in (("parser_id", parser_id), ("kind", kind)):
        s = s if value is None else s.filter(F.col(column) == value)
    return s.select("name", "qualified", "kind", "signature", "path", "line_start", "line_end", "scope", "parent_id", "id").orderBy("line_start", "id")


def get_outline_under_path(facts, manifest_id: int, prefix: str, parser_id: str | None = None, limit: int = 200, kind: str | None = None, max_depth: int | None = None) -> DataFrame:
    """Symbols of files under a literal path prefix, at most so many directories deep."""
    entries = entries_of(facts.manifest_entries, manifest_id).filter(F.col("path").startswith(prefix))
    if max_depth is not None:
        rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
        entries = entries.filter(F.length(rest) - F.length(F.replace(rest, F.lit("/"), F.lit(""))) <= max_depth - 1)
    s = facts.symbols.join(entries, "blob_sha")
    for column, value in (("parser_id", parser_id), ("kind", kind)):
        s = s if value is None else s.filter(F.col(column) == value)
    return s.select("name", "qualified", "kind", "path", "line_start", "line_end", "id").orderBy("path", "line_start", "id").limit(max(1, limit))


def symbol_source_rows(facts, manifest_id: int, qualified: str, file: str | None = None, line: int | None = None, limit: int = SOURCE_CANDIDATES + 1) -> DataFrame:
    """Physical declarations of a qualified name: one row per path and byte range, of the first parser."""
    if line is not None and (file is None or line < 1):
        raise ValueError("line needs a file and is at least 1")
    entries = entries_of(facts.manifest_entries, manifest_id)
    entries = entries if file is None else entries.filter(F.col("path") == file)
    s = facts.symbols.filter(F.col("qualified") == qualified)
    s = s if line is None else s.filter(F.col("line_start") == line)
    s = s.join(entries, "blob_sha")
    w = W.partitionBy("path", "blob_sha", "byte_start", "byte_end").orderBy("parser_id", "id")
    s = s.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    s = s.select(F.col("id").alias("symbol_id"), "qualified", "kind", "signature", "path", "blob_sha", "parser_id", "line_start", "line_end", "byte_start", "byte_end")
    return s.orderBy("path", "line_start", "byte_start", "byte_end", "blob_sha").limit(max(1, limit))


class AmbiguousSource(LookupError):
    def __init__(self, candidates: list, truncated: bool):
        super().__init__(f"{len(candidates)} declarations{' or more' if truncated else ''}")
        self.candidates, self.truncated = candidates, truncated


def get_symbol_source(facts, contents: DataFrame, manifest_id: int, qualified: str, file: str | None = None, line: int | None = None, signature_only: bool = False) -> DataFrame:
    """The one declaration and its source text from ``contents`` (blob_sha, content binary)."""
    rows = symbol_source_rows(facts, manifest_id, qualified, file, line)
    found = rows.collect()  # at most SOURCE_CANDIDATES + 1
    if not found:
        raise LookupError(qualified)
    if len(found) > 1:
        raise AmbiguousSource(found[:SOURCE_CANDIDATES], len(found) > SOURCE_CANDIDATES)
    if signature_only:
        return rows.withColumn("source_text", F.lit(""))
    return rows.join(contents, "blob_sha", "left").withColumn("source_text", body_of(F.col("content"), F.col("byte_start"), F.col("byte_end"))).drop("content")


def bytes_of(content: Column, start: Column, end: Column) -> Column:
    """Bytes start to end of a blob."""
    return F.substring(content, (start + 1).cast("int"), (end - start).cast("int"))


def body_of(content: Column, start: Column, end: Column) -> Column:
    """Bytes start to end of a blob as text; what is no UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(bytes_of(content, start, end).cast("string"))


def dedup_sources(rows: DataFrame) -> DataFrame:
    """Over many repositories: the first alias of each physical declaration."""
    w = W.partitionBy("repo_hash", "manifest_id", "path", "blob_sha", "byte_start", "byte_end").orderBy("alias", "parser_id", "symbol_id")
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def with_snippets(hits: DataFrame, contents: DataFrame) -> DataFrame:
    """The line of each hit (blob_sha, line), from text contents (blob_sha, content); null without content.

    Contents are cut into lines once each, and hits meet lines, whatever the number of hits in a blob."""
    lines = contents.dropDuplicates(["blob_sha"]).select("blob_sha", F.posexplode(F.split("content", "\n")).alias("_at", "snippet"))
    lines = lines.select(F.col("blob_sha").alias("_blob"), (F.col("_at") + 1).cast("long").alias("_line"), text.without_return(F.col("snippet")).alias("snippet"))
    found = hits.drop("snippet").join(lines, (F.col("blob_sha") == F.col("_blob")) & (F.col("line").cast("long") == F.col("_line")), "left")
    return found.drop("_blob", "_line")


def probe(df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """(rows up to the limit, whether there are more), from one row more than the limit."""
    more = df.limit(limit + 1).count() > limit
    return df.limit(limit), more


def completeness(capped: bool, stale: bool, unavailable: bool) -> tuple[str, str | None]:
    """complete or partial, and of the reasons for partial the first of stale, unavailable, capped."""
    for reason, holds in (("stale", stale), ("unavailable", unavailable), ("capped", capped)):
        if holds:
            return "partial", reason
    return "complete", None
