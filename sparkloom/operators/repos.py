"""Repositories, snapshots, jobs and analyzers: listings and status aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import text

ACTIVE = ("queued", "running")


def count_files(entries: DataFrame) -> DataFrame:
    """Files per manifest."""
    return entries.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("files"))


def count_symbols(entries: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols per manifest; content at two paths counts twice. Counted per blob first, so that the join is small."""
    per_blob = symbols.groupBy("blob_sha").agg(F.count(F.lit(1)).alias("n"))
    return entries.join(per_blob, "blob_sha").groupBy("manifest_id").agg(F.sum("n").alias("symbols"))


def anchored(df: DataFrame, anchors: DataFrame) -> DataFrame:
    return df.join(anchors.select("manifest_id").distinct(), "manifest_id", "left_semi")


def jobs_by_status(runs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Jobs of anchored manifests by status."""
    return anchored(runs.filter("job_id IS NOT NULL"), anchors).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


def active_jobs(runs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Queued and running jobs of each anchored manifest, manifests without any included."""
    seen = runs.filter(F.col("job_id").isNotNull() & F.col("status").isin(*ACTIVE)).groupBy("manifest_id").agg(F.count(F.lit(1)).alias("active"))
    return anchors.select("manifest_id").distinct().join(seen, "manifest_id", "left").select("manifest_id", F.coalesce("active", F.lit(0).cast("long")).alias("active"))


def list_jobs(runs: DataFrame, anchors: DataFrame, state: str | None = None, include_terminal: bool = False, limit: int | None = None) -> DataFrame:
    """Jobs, latest first: active ones unless a state or terminal ones are asked for."""
    jobs = runs.filter("job_id IS NOT NULL")
    if state is not None:
        jobs = jobs.filter(F.col("status") == state)
    elif not include_terminal:
        jobs = jobs.filter(F.col("status").isin(*ACTIVE))
    ms = F.floor((F.col("finished_at_ns") - F.col("started_at_ns")) / 1_000_000)
    jobs = anchored(jobs, anchors).select("job_id", "manifest_id", "analyzer_id", "status", "started_at_ns", "finished_at_ns", ms.alias("run_ms"), "error", "cancel_requested")
    jobs = jobs.orderBy(F.desc("job_id"), "manifest_id", "analyzer_id")
    return jobs if limit is None else jobs.limit(limit)


def parsers_of(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Distinct parsers of each manifest."""
    return entries.join(blobs, "blob_sha").select("manifest_id", "parser_id").distinct()


def enrichment(entries: DataFrame, blobs: DataFrame, analyzers: DataFrame) -> DataFrame:
    """Per manifest and language: whether an analyzer exists for one of its parsers, and semantic if that of a parser did run on one of its blobs.

    analyzers (parser_id, analyzer_id): those that exist; one that works on whole snapshots has no analyzer_id, as it leaves none in blobs."""
    per_parser = analyzers.groupBy("parser_id").agg(F.max("analyzer_id").alias("_own"), F.lit(True).alias("_has"))
    rows = entries.join(blobs, "blob_sha").groupBy("manifest_id", "parser_id", "analyzer_id").agg(F.lit(1).alias("_n")).join(per_parser, "parser_id", "left")
    ran = F.max(F.coalesce(F.col("analyzer_id") == F.col("_own"), F.lit(False)))
    by = rows.groupBy("manifest_id", text.language_of(F.col("parser_id")).alias("language"))
    return by.agg(F.when(ran, "semantic").otherwise("syntactic").alias("tier"), F.max(F.coalesce("_has", F.lit(False))).alias("has_analyzer"))


def snapshots(anchors: DataFrame) -> DataFrame:
    """Anchors of each manifest, in display order, and when they last changed."""
    name = F.col("anchor_name")
    labels = F.sort_array(F.collect_list(F.struct(text.anchor_rank(name).alias("r"), text.anchor_key(name).alias("k"), name.alias("name"))))
    grouped = anchors.groupBy("manifest_id").agg(labels.alias("_l"), F.max("last_updated_ns").alias("last_updated_ns"))
    return grouped.select("manifest_id", F.transform("_l", lambda x: x["name"]).alias("labels"), "last_updated_ns")


def aggregate_status(status_rows: DataFrame, by: str, active: Column) -> DataFrame:
    """Of snapshot states (status): error, indexing, partial or ready."""
    has = lambda *s: F.bool_or(F.col("status").isin(*s))
    none = F.count("status") == 0
    status = F.when(none | has("missing"), "error").when((F.max(active) > 0) | has("reconciling"), "indexing").when(has("stale", "no_analyzer"), "partial").otherwise("ready")
    return status_rows.groupBy(by).agg(status.alias("aggregate_status"))


def resolve_repo_by_path(paths: DataFrame, repositories: DataFrame) -> DataFrame:
    """The repository with the longest root that is a path-component prefix of each path (path).

    Instead of a theta join every path is exploded to its own ancestors, which then meet roots by equality."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    up = paths.select("path").distinct().withColumn("root_path", F.explode(ancestors))
    hits = up.join(repositories, "root_path")
    best = hits.groupBy("path").agg(F.max_by(F.struct("repo_hash", "root_path"), F.length("root_path")).alias("_b"))
    return paths.join(best, "path", "left").select("path", "_b.repo_hash", "_b.root_path")


def snapshot_states(facts) -> DataFrame:
    """Each snapshot (manifest) that an anchor of a repository names (facts.repo_anchors: repo_hash, anchor_name, manifest_id): its languages, counts and status.

    empty without a file, ready with symbols, else stale if an analyzer exists for one of its languages, else no_analyzer."""
    shots = facts.repo_anchors.select("repo_hash", "manifest_id").distinct()
    here = facts.manifest_entries.join(shots.select("manifest_id").distinct(), "manifest_id", "left_semi")
    enriched = enrichment(here, facts.blobs, facts.analyzers).groupBy("manifest_id").agg(F.array_sort(F.collect_set("language")).alias("languages"), F.bool_or("has_analyzer").alias("_has"))
    zero = F.lit(0).cast("long")
    rows = shots.join(count_files(here), "manifest_id", "left").join(count_symbols(here, facts.symbols), "manifest_id", "left").join(enriched, "manifest_id", "left")
    rows = rows.withColumns({"files": F.coalesce("files", zero), "symbols": F.coalesce("symbols", zero), "languages": F.coalesce("languages", F.array().cast("array<string>"))})
    # fixed values: states of snapshots
    status = F.when(F.col("files") == 0, "empty").when(F.col("symbols") > 0, "ready").when(F.coalesce("_has", F.lit(False)), "stale").otherwise("no_analyzer")
    return rows.select("repo_hash", "manifest_id", "languages", "files", "symbols", status.alias("status"))


def repo_snapshots(facts) -> DataFrame:
    """The snapshots of each repository in display order (position from 1), with their labels."""
    name = F.col("anchor_name")
    label = F.struct(text.anchor_rank(name).alias("r"), text.anchor_key(name).alias("k"), F.regexp_replace(name, "^branch/", "").alias("name"))
    labels = facts.repo_anchors.groupBy("repo_hash", "manifest_id").agg(F.sort_array(F.collect_list(label)).alias("_l"))
    rows = snapshot_states(facts).join(labels, ["repo_hash", "manifest_id"])
    first = F.col("_l")[0]
    place = F.row_number().over(W.partitionBy("repo_hash").orderBy(first["r"], first["k"], "manifest_id"))
    return rows.select("repo_hash", place.alias("position"), "manifest_id", F.transform("_l", lambda x: x["name"]).alias("labels"), "status", "files", "symbols", "languages")


def list_repos(aliases: DataFrame, repositories: DataFrame, facts, query: str | None = None, limit: int | None = None) -> DataFrame:
    """Aliases with their repository's languages and number of snapshots over all of its anchors, counts of its current snapshot, and status."""
    repos = aliases.join(repositories.drop("registered_at_ns"), "repo_hash")
    if query is not None:
        repos = repos.filter(F.col("alias").contains(query) | F.col("root_path").contains(query))
    states = snapshot_states(facts)
    shots = states.groupBy("repo_hash").agg(F.count(F.lit(1)).alias("snapshots"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("languages")))), ",").alias("languages"))
    active = active_jobs(facts.runs, facts.repo_anchors)
    status = aggregate_status(states.join(active, "manifest_id", "left"), "repo_hash", F.col("active"))
    out = repos.join(states.select("repo_hash", "manifest_id", "files", "symbols"), ["repo_hash", "manifest_id"], "left").join(shots, "repo_hash", "left").join(status, "repo_hash", "left")
    zero = F.lit(0).cast("long")
    out = out.select(
        "alias",
        "root_path",
        F.coalesce("languages", F.lit("")).alias("languages"),
        F.coalesce("snapshots", zero).alias("snapshot_count"),
        F.coalesce("files", zero).alias("current_file_count"),
        F.coalesce("symbols", zero).alias("current_symbol_count"),
        F.coalesce("aggregate_status", F.lit("error")).alias("status"),
    ).orderBy("alias")
    return out if limit is None else out.limit(limit)


def repo_status(aliases: DataFrame, repositories: DataFrame, facts, repo: str | None = None, path: str | None = None) -> DataFrame:
    """One repository by alias, or by the longest root that holds a path."""
    if (repo is None) == (path is None):
        raise ValueError("exactly one of repo and path is needed")
    if repo is None:
        spark = repositories.sparkSession
        owner = resolve_repo_by_path(spark.createDataFrame([(path,)], "path string"), repositories).select("repo_hash")
        aliases = aliases.join(owner, "repo_hash", "left_semi")
    else:
        aliases = aliases.filter(F.col("alias") == repo)
    return list_repos(aliases, repositories, facts)


def tier_status(analyzers: DataFrame, parsers: DataFrame, runs: DataFrame, manifest_id: int) -> DataFrame:
    """State and reason of each expected analyzer (analyzer_id, parser_id, revision) in a manifest, and
    not_applicable for parsers without one."""
    here = parsers.filter(F.col("manifest_id") == manifest_id).select("parser_id")
    runs = runs.filter(F.col("manifest_id") == manifest_id).select("analyzer_id", "status", "error", "analyzer_revision")
    known = analyzers.join(here, "parser_id", "left_semi").join(runs, "analyzer_id", "left")
    status, missing = F.col("status"), F.col("status").isNull()
    old = F.col("analyzer_revision") != F.col("revision")
    state = F.when(missing, "missing").when(old, "stale").when(status == "succeeded", "ready").when(status.isin("queued", "running", "skipped"), status).otherwise("failed")
    code = F.when(missing, "not_scheduled").when(old, "stale").otherwise(text.reason_code(status, F.col("error")))
    known = known.select("analyzer_id", "parser_id", state.alias("state"), code.alias("reason_code"))
    none = here.join(analyzers, "parser_id", "left_anti").select(F.lit(None).cast("string").alias("analyzer_id"), "parser_id", F.lit("not_applicable").alias("state"), F.lit("not_applicable").alias("reason_code"))
    return known.unionByName(none).distinct()


def diagnostics(result: dict) -> list[str]:
    """Hints from a result's metadata: completeness (with its reason), analyzer states and filters in use."""
    out = []
    reason = result.get("reason")
    if reason == "stale":
        out.append("the snapshot is behind the worktree: results may be out of date")
    elif reason == "unavailable":
        out.append("a repository could not be read: results are partial")
    elif reason == "capped":
        out.append("there are more results than the limit: raise it or narrow the query")
    states = set(result.get("states", ()))
    if states & {"queued", "running"}:
        out.append("an analyzer is still at work: cross-file targets may follow")
    if states & {"failed", "missing", "stale"}:
        out.append("an analyzer has no current result: cross-file targets may be missing")
    if not result.get("rows") and result.get("kind"):
        out.append("no row of this kind: try without the kind filter")
    return out


def with_first_registration(aliases: DataFrame) -> DataFrame:
    """When each repository was first registered under any alias."""
    return aliases.groupBy("repo_hash").agg(F.min("registered_at_ns").alias("registered_at_ns"))


def latest_per(df: DataFrame, by: list[str], order: list) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
