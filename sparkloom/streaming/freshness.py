"""Freshness of snapshots: why one is stale, in fixed precedence, and which repositories are due for a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_AGE_NS = 30 * 60 * 1_000_000_000
POLL_NS, MARGIN_NS = 5 * 60 * 1_000_000_000, 5 * 60 * 1_000_000_000


def stale_reason(now_ns: Column, max_age_ns: int = MAX_AGE_NS, state_missing: Column | None = None) -> Column:
    """Null if fresh. Reads anchor_name, attempt, desired, applied, watcher_error, watcher_state, last_success_ns and reconcile_generation."""
    reason = F.when(~F.coalesce(F.col("anchor_name").rlike("^tentative/[0-9]+$"), F.lit(False)), "missing_tentative_snapshot")
    if state_missing is not None:
        reason = reason.when(state_missing, "missing_reconcile_state")
    return (
        reason.when(F.col("attempt").isNotNull(), "reconcile_in_progress")
        .when(F.col("desired") != F.col("applied"), "reconcile_generation_gap")
        .when(F.col("watcher_error").isNotNull() | (F.col("watcher_state") == "failed"), "watcher_failed")
        .when(F.col("watcher_state") != "active", "watcher_inactive")
        .when(F.col("last_success_ns").isNull(), "never_reconciled")
        .when(now_ns - F.col("last_success_ns") > max_age_ns, "snapshot_scan_too_old")
        .when(F.col("reconcile_generation").isNull(), "missing_publication_receipt")
        .when(F.col("reconcile_generation") != F.col("applied"), "publication_generation_mismatch")
    )


def status_label(reason: Column) -> Column:
    return F.when(reason.isNull(), "current").when(reason.isin("reconcile_in_progress", "reconcile_generation_gap"), "reconciling").otherwise("stale")


def revalidated(before: DataFrame, after: DataFrame, fingerprint: list[str]) -> DataFrame:
    """``before`` (repo_hash, reason, fingerprint columns) with snapshot_changed_during_query where the fingerprint changed meanwhile."""
    then = after.select("repo_hash", F.struct(*fingerprint).alias("_then"))
    same = F.struct(*fingerprint).eqNullSafe(F.col("_then"))
    reason = F.when(F.col("reason").isNull() & ~same, "snapshot_changed_during_query").otherwise(F.col("reason"))
    return before.join(then, "repo_hash", "left").withColumn("reason", reason).drop("_then")


def periodic_due(repositories: DataFrame, states: DataFrame, now_ns: int, age_ns: int = MAX_AGE_NS - MARGIN_NS) -> DataFrame:
    """States of the repositories (repo_hash, removal_requested_at_ns) that are due: not to be removed, clean, idle, and without a success that is younger than so much."""
    kept = repositories.filter("removal_requested_at_ns IS NULL").select("repo_hash")
    old = F.col("last_success_ns").isNull() | (F.col("last_success_ns") <= now_ns - age_ns)
    return states.filter((F.col("desired") == F.col("applied")) & F.col("attempt").isNull() & old).join(kept, "repo_hash", "left_semi")
