"""Maintenance: staleness of parsers and analyzers, reruns, pruning, and checks of the store's state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of runs that are over.
TERMINAL = ("succeeded", "failed", "skipped", "cancelled", "timed_out")


def to_parse(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """Distinct units (blob_sha, parser_id, parser_revision, analyzer_id, analyzer_revision) that no stored blob equals: what is left to parse."""
    keys = ["blob_sha", "parser_id"]
    have = blobs.select(*keys, F.col("parser_revision").alias("_p"), F.col("analyzer_id").alias("_a"), F.col("analyzer_revision").alias("_r"), F.lit(True).alias("_have"))
    units = wanted.dropDuplicates(keys).join(have, keys, "left")
    same = (F.col("_p") == F.col("parser_revision")) & F.col("_a").eqNullSafe(F.col("analyzer_id")) & F.col("_r").eqNullSafe(F.col("analyzer_revision"))
    return units.filter(~F.coalesce(same, F.lit(False))).select(*wanted.columns)


def parser_drift(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """Units (blob_sha, parser_id, parser_revision) that are not stored or have another revision."""
    have = blobs.select("blob_sha", "parser_id", F.col("parser_revision").alias("stored"))
    return wanted.join(have, ["blob_sha", "parser_id"], "left").filter(F.col("stored").isNull() | (F.col("stored") != F.col("parser_revision")))


def stale_revisions(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """Drifted units by parser and stored revision, with their number."""
    drift = parser_drift(wanted, blobs).groupBy("parser_id", F.col("stored").alias("current_rev"))
    out = drift.agg(F.max("parser_revision").alias("expected_rev"), F.count(F.lit(1)).alias("affected"))
    return out.orderBy("parser_id", F.col("current_rev").asc_nulls_last())


def classify_run(expected: Column, revision: Column, status: Column) -> Column:
    """What to do about an analyzer's run: enqueue, active_stale, skip or terminal_failed_current."""
    decision = F.when(revision.isNull(), "enqueue").when((revision < expected) & status.isin("queued", "running"), "active_stale")
    decision = decision.when(revision < expected, "enqueue").when(revision > expected, "skip")
    return decision.when(status.isin("failed", "timed_out", "cancelled"), "terminal_failed_current").otherwise("skip")


def reruns(expected: DataFrame, runs: DataFrame, config_hash: str) -> DataFrame:
    """Expected analyzers (manifest_id, analyzer_id, revision) without a current, successful run."""
    have = runs.select("manifest_id", "analyzer_id", "status", "analyzer_revision", F.col("config_hash").alias("_c"))
    rows = expected.join(have, ["manifest_id", "analyzer_id"], "left")
    due = F.col("status").isNull() | (F.col("status") != "succeeded") | (F.col("analyzer_revision") != F.col("revision")) | (F.col("_c") != config_hash)
    return rows.filter(due).select(*expected.columns)


def prune_blobs(blobs: DataFrame, parsers: list[str]) -> DataFrame:
    """Blobs of known parsers; without any known parser nothing may be pruned."""
    if not parsers:
        raise ValueError("no parser is known: nothing is pruned")
    return blobs.filter(F.col("parser_id").isin(*parsers))


def prune_jobs(runs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Runs without the terminal ones whose manifest no anchor names."""
    named = anchors.select("manifest_id").distinct().withColumn("_named", F.lit(True))
    return runs.join(named, "manifest_id", "left").filter(F.col("_named") | ~F.col("status").isin(*TERMINAL)).drop("_named").select(*runs.columns)


def cancel_job(runs: DataFrame, job_id: int) -> DataFrame:
    """Runs with the cancel flag set on an active job."""
    hit = (F.col("job_id") == job_id) & F.col("status").isin("queued", "running")
    return runs.withColumn("cancel_requested", F.coalesce(hit, F.lit(False)) | F.col("cancel_requested"))


def prune_stale_refs(anchors: DataFrame, live: DataFrame) -> DataFrame:
    """Anchors without the branches and tags that are no live ref (anchor_name)."""
    refs = F.col("anchor_name").startswith("branch/") | F.col("anchor_name").startswith("tag/")
    return anchors.filter(~refs).unionByName(anchors.filter(refs).join(live, "anchor_name", "left_semi"))


#: Checks of a store by the table that each reads: its name, the level of a finding, and what a finding is; a column with an underscore says whether a row has its partner.
CHECKS: dict[str, list[tuple[str, str, str]]] = {
    "anchors": [("anchors without manifest", "error", "NOT _manifest")],
    "manifest_entries": [("entries without manifest", "error", "NOT _manifest"), ("entries without blob", "warn", "NOT _blob")],
    "blobs": [("blobs in no manifest", "info", "NOT _entry"), ("analyzed blobs without revision", "warn", "analyzer_id IS NOT NULL AND analyzer_revision IS NULL")],
    "symbols": [("symbols without blob", "error", "NOT _unit"), ("symbols without parent", "error", "parent_id IS NOT NULL AND NOT _parent"), ("symbols that end before they start", "error", "byte_end < byte_start OR line_end < line_start")],
    "refs": [("references without enclosing symbol", "error", "enclosing_id IS NOT NULL AND NOT _enclosing"), ("references without blob", "error", "NOT _unit")],
    "resolutions": [("resolutions without path", "error", "target_symbol_id IS NOT NULL AND target_path IS NULL"), ("resolutions without symbol", "warn", "target_symbol_id IS NOT NULL AND NOT _target")],
    "wanted": [("parser drift", "warn", "stored IS NULL OR stored <> parser_revision")],
    "runs": [
        ("failed runs", "warn", "status IN ('failed', 'timed_out')"), ("runs without manifest", "info", "NOT _manifest"), ("active runs without job", "warn", "status IN ('queued', 'running') AND job_id IS NULL"),
        ("runs that end before they start", "error", "finished_at_ns < started_at_ns"), ("ended runs without an end", "error", "status NOT IN ('queued', 'running') AND finished_at_ns IS NULL"),
    ],
    "reconcile_state": [
        ("reconcile states ahead", "error", "applied > desired OR attempt > desired"), ("failed watchers", "warn", "watcher_state = 'failed' OR watcher_error IS NOT NULL"),
        ("repeated failures", "warn", "consecutive_failures >= 3"), ("states that never succeeded", "info", "last_success_ns IS NULL"),
    ],
}


def doctor(facts, wanted: DataFrame) -> DataFrame:
    """(check, level, findings) over a store: all checks of a table in one pass over it, with a join for each table that it must agree with. No rows are collected."""

    def known(table: DataFrame, mark: str, *columns: str) -> DataFrame:
        return table.select(*[F.col(c.split(" AS ")[0]).alias(c.split(" AS ")[-1]) for c in columns]).distinct().withColumn(mark, F.lit(True))

    def beside(df: DataFrame, *partners: DataFrame) -> DataFrame:
        for p in partners:
            mark = p.columns[-1]
            df = df.join(p, p.columns[:-1], "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
        return df

    manifest, unit = known(facts.manifests, "_manifest", "manifest_id"), known(facts.blobs, "_unit", "blob_sha", "parser_id")
    symbol = lambda mark, name: known(facts.symbols, mark, f"id AS {name}")
    tables = {
        "anchors": beside(facts.anchors, manifest),
        "manifest_entries": beside(facts.manifest_entries, manifest, known(facts.blobs, "_blob", "blob_sha")),
        "blobs": beside(facts.blobs, known(facts.manifest_entries, "_entry", "blob_sha")),
        "symbols": beside(facts.symbols, unit, symbol("_parent", "parent_id")),
        "refs": beside(facts.refs, unit, symbol("_enclosing", "enclosing_id")),
        "resolutions": beside(facts.resolutions, symbol("_target", "target_symbol_id")),
        "wanted": wanted.join(facts.blobs.select("blob_sha", "parser_id", F.col("parser_revision").alias("stored")), ["blob_sha", "parser_id"], "left"),
        "runs": beside(facts.runs, manifest),
        "reconcile_state": facts.reconcile_state,
    }

    def findings(name: str) -> DataFrame:
        one = [F.struct(F.lit(check).alias("check"), F.lit(level).alias("bad"), F.count_if(F.expr(finding)).alias("findings")) for check, level, finding in CHECKS[name]]
        rows = tables[name].agg(F.array(*one).alias("_rows")).select(F.inline("_rows"))
        return rows.select("check", F.when(F.col("findings") > 0, F.col("bad")).otherwise("ok").alias("level"), "findings")

    return reduce(lambda a, b: a.unionByName(b), map(findings, CHECKS))
