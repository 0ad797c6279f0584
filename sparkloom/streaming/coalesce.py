"""Change events: classification, collapse to rescans, and windows that open at their first event.

A window of fixed length opens with the first event after the last one closed; it yields one row. That is neither a tumbling
window (which opens on a grid) nor a session (which every event prolongs), so it is stateful.

In a batch a repository is no single task. Times are dealt over buckets of a window's length. Where no event came for so long, a window opens in any case, so a repository falls into stretches that do not
depend on each other; a bucket next to its neighbour tells whether one begins there, and which stretch it is of comes from a scan in parts. A stretch is walked through in order; in one of more than
``LONG_STRETCH`` times each time points to the one that would open the next window, and the windows are found by doubling these pointers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.sources.ignore import PRUNED
from sparkloom.sources.shared import written

WINDOW_US = 500_000
#: Different times of a stretch that one task walks through at most.
LONG_STRETCH = 500_000
# Changes of events. A rename is that of a file or a folder.
TOUCH, REMOVE, TOPOLOGY = ("create", "modify", "rename", "create_dir"), ("remove", "remove_dir"), ("rename", "create_dir", "remove_dir")


def rescan_reason(path: Column, change: Column) -> Column:
    """Why a change at a path below a repository's root calls for a scan of all of it; null if it does not."""
    git, name = path.rlike(r"^\.git(/|$)"), F.element_at(F.split(path, "/"), -1)
    nested = (name == ".git") & change.isin("create", "remove", *TOPOLOGY)  # of a repository inside this one
    # fixed values: the reasons
    reason = F.when(change == "overflow", "backend_requested").when((path == ".git/info/exclude") | (~git & (name == ".gitignore")), "ignore_rules_changed")
    return reason.when(~git & (nested | change.isin(*TOPOLOGY)), "directory_topology_changed")


def classify(path: Column, change: Column) -> Column:
    """file_touched, file_deleted, git, rescan or null (nothing to do) of a change at a path below a repository's root."""
    moved = path.rlike(r"^\.git/(HEAD|packed-refs|worktrees/[^/]+/HEAD)$") & change.isin(*TOUCH)
    branch = path.rlike(r"^\.git/refs/heads/.") & change.isin(*TOUCH, *REMOVE)
    dropped = F.exists(F.split(path, "/"), lambda p: p.isin(*sorted(PRUNED)))
    file = F.when(change.isin("create", "modify"), "file_touched").when(change == "remove", "file_deleted")
    kind = F.when(rescan_reason(path, change).isNotNull(), "rescan").when(moved | branch, "git")
    return kind.when(path.rlike(r"^\.git(/|$)") | dropped, F.lit(None).cast("string")).otherwise(file)


def collapse(events: DataFrame, by: list[str]) -> DataFrame:
    """Events (kind, path) per window: a single rescan if there is one among them, else each path's last kind. With a column reason, a rescan has that of its first event."""
    if "reason" in events.columns:
        order = F.struct("at", "seq")
        first = events.filter("kind = 'rescan'").groupBy(*by).agg(F.min_by("reason", order).alias("reason"))
        return collapse(events.drop("reason"), by).join(first, by, "left")
    marked = events.withColumn("_rescan", F.bool_or(F.col("kind") == "rescan").over(W.partitionBy(*by)))
    scans = marked.filter("_rescan").select(*by, F.lit("rescan").alias("kind"), F.lit(None).cast("string").alias("path")).distinct()
    files = marked.filter("NOT _rescan").groupBy(*by, "path").agg(F.max_by("kind", F.struct("at", "seq")).alias("kind"))
    return scans.unionByName(files.select(*by, "kind", "path"))


def debounced(events: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """Bursts (repo, path, start, end, events) of events (repo, path, ts) without a gap of that length; works on streams too."""
    w = F.session_window("ts", gap)
    return events.groupBy("repo", "path", w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select("repo", "path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def with_stretches(buckets: DataFrame, length_us: int) -> DataFrame:
    """Buckets (repo, b, low, high: their first and last time) and the bucket in which their stretch begins (stretch)."""
    before = buckets.select("repo", (F.col("b") + 1).alias("b"), F.col("high").alias("_high"))
    marked = buckets.join(before, ["repo", "b"], "left")
    begins = F.when(F.col("_high").isNull() | (F.col("low") - F.col("_high") >= length_us), F.col("b"))
    parts = marked.select("repo", "b", "low", "high", begins.alias("_begins")).repartitionByRange("repo", "b")
    parts = written(parts.withColumn("_part", F.spark_partition_id()), "buckets")
    here = F.max("_begins").over(W.partitionBy("repo", "_part").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow))
    # what the parts before end with, for repositories that go on from there
    last = parts.groupBy("repo", "_part").agg(F.max("_begins").alias("_last"))
    carried = F.max("_last").over(W.partitionBy("repo").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    carry = last.withColumn("_carry", carried).drop("_last")
    return parts.withColumn("_here", here).join(carry, ["repo", "_part"]).select("repo", "b", "low", "high", F.coalesce("_here", "_carry").alias("stretch"))


def windows_batch(events: DataFrame, length_us: int = WINDOW_US) -> DataFrame:
    """(repo, start, events) of each window over events (repo, at)."""
    times = events.groupBy("repo", "at").agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.expr(f"at div {length_us} - CAST(at % {length_us} < 0 AS INT)"))
    times = written(times, "times")
    buckets = with_stretches(times.groupBy("repo", "b").agg(F.min("at").alias("low"), F.max("at").alias("high")), length_us)
    times = written(times.join(buckets.select("repo", "b", "stretch"), ["repo", "b"]), "times")
    sizes = times.groupBy("repo", "stretch").agg(F.count(F.lit(1)).alias("k"))
    long = written(sizes.filter(F.col("k") > LONG_STRETCH).select("repo", "stretch"), "long")
    if long.isEmpty():
        return walked(times, length_us)
    return walked(times.join(long, ["repo", "stretch"], "left_anti"), length_us).unionAll(doubled(times.join(long, ["repo", "stretch"]), length_us))


def walked(times: DataFrame, length_us: int) -> DataFrame:
    """The windows of stretches that are passed through in order, in Arrow batches; only the open window is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list = []  # repo, start, events

        for b in batches:
            out = []
            for repo, at, n in zip(b["repo"], b["at"], b["n"], strict=True):
                if open_ and open_[0] == repo and at < open_[1] + length_us and at >= open_[1]:
                    open_[2] += n
                else:
                    out += [tuple(open_)] if open_ else []
                    open_ = [repo, at, n]
            if out:
                yield pd.DataFrame(out, columns=["repo", "start", "events"])
        if open_:
            yield pd.DataFrame([open_], columns=["repo", "start", "events"])

    ordered = times.select("repo", "stretch", "at", "n").repartition("repo", "stretch").sortWithinPartitions("repo", "stretch", "at")
    return ordered.mapInPandas(run, "repo string, start long, events long")


def doubled(times: DataFrame, length_us: int) -> DataFrame:
    """The windows of long stretches, whose buckets all have times: pointers to the time that opens the next window, doubled until none is left."""
    asked = times.select("repo", "stretch", (F.col("b") + 1).alias("b"), (F.col("at") + length_us).alias("v"), F.col("at").alias("x"))
    both = times.select("repo", "stretch", "b", F.col("at").alias("v"), F.lit(None).cast("long").alias("x")).unionAll(asked)
    later = F.min(F.when(F.col("x").isNull(), F.col("v"))).over(W.partitionBy("repo", "stretch", "b").orderBy("v").rangeBetween(W.currentRow, W.unboundedFollowing))
    first = times.groupBy("repo", "stretch", (F.col("b") - 1).alias("b")).agg(F.min("at").alias("_next"))
    jump = both.withColumn("y", later).filter("x IS NOT NULL").join(first, ["repo", "stretch", "b"], "left")
    jump = written(jump.select("repo", "stretch", "x", F.coalesce("y", "_next").alias("y")).filter("y IS NOT NULL"), "jump")
    found = written(times.groupBy("repo", "stretch").agg(F.min("at").alias("x")), "windows")
    while not jump.isEmpty():
        found = written(found.unionAll(found.join(jump, ["repo", "stretch", "x"]).select("repo", "stretch", F.col("y").alias("x"))), "windows")
        on = jump.select("repo", "stretch", F.col("x").alias("y"), F.col("y").alias("z"))
        jump = written(jump.join(on, ["repo", "stretch", "y"]).select("repo", "stretch", "x", F.col("z").alias("y")), "jump")
    # a bucket is as long as a window, so at most one begins in it; other times of it belong to the one before
    begins = found.select("repo", "stretch", F.expr(f"x div {length_us} - CAST(x % {length_us} < 0 AS INT)").alias("b"), F.col("x").alias("_own"))
    before = begins.select("repo", "stretch", (F.col("b") + 1).alias("b"), F.col("_own").alias("_before"))
    of = times.join(begins, ["repo", "stretch", "b"], "left").join(before, ["repo", "stretch", "b"], "left")
    start = F.when(F.col("at") >= F.col("_own"), F.col("_own")).otherwise(F.col("_before"))
    return of.groupBy("repo", start.alias("start")).agg(F.sum("n").alias("events"))


SCHEMA, STATE = "repo string, start long, events long", "start long, events long"


def windows_stream(events: DataFrame, length_ms: int = WINDOW_US // 1000) -> DataFrame:
    """One row (repo, start, events) per window of a stream (repo, at), when the window's time is over; the open window is kept
    as state until then, so nothing is lost between micro-batches."""

    def fold(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            start, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], start, n)], columns=["repo", "start", "events"])
            return
        start, n = state.get if state.exists else (None, 0)
        out = []
        for at in sorted(int(x) for b in batches for x in b["at"]):
            if start is not None and at >= start + length_ms * 1000:
                out.append((key[0], start, n))
                start, n = None, 0
            start, n = (at, 1) if start is None else (start, n + 1)
        state.update((start, n))
        state.setTimeoutDuration(length_ms)
        yield pd.DataFrame(out, columns=["repo", "start", "events"])

    return events.groupBy("repo").applyInPandasWithState(fold, SCHEMA, STATE, "append", "ProcessingTimeTimeout")
