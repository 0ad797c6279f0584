"""Sources and sinks: worktrees, git trees, blobs, and fact tables with a published pointer.

A worktree scan reads each file once; its hash and its facts come from the same row.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparkloom.functions.text import git_sha
from sparkloom.sources.ignore import PRUNED, IgnoreRules


class ScanRejected(RuntimeError):
    """A scan met an error: none of its rows may be used."""


def listed(root: str) -> tuple[list[str], IgnoreRules]:
    """Paths below ``root`` of all regular files that no rule ignores, in order. Any error rejects the whole scan."""

    def fail(error: OSError) -> None:
        raise ScanRejected(str(error)) from error

    files: dict[str, str] = {}
    exclude, nested, every = "", [], []
    base = Path(root)
    if (own := base / ".git" / "info" / "exclude").is_file():
        exclude = own.read_text(errors="replace")
    for at, folders, names in os.walk(root, onerror=fail):
        here = os.path.relpath(at, root).replace(os.sep, "/")
        here = "" if here == "." else here
        if here and ".git" in (*folders, *names):
            nested.append(here)
            folders.clear()
            continue
        folders[:] = [f for f in folders if f not in PRUNED]
        if ".gitignore" in names:
            files[here] = (Path(at) / ".gitignore").read_text(errors="replace")
        every += [f"{here}/{n}" if here else n for n in names if not (Path(at) / n).is_symlink() and (Path(at) / n).is_file()]
    rules = IgnoreRules(files, exclude, nested)
    return sorted(p for p in every if not rules.ignored(p)), rules


def worktree(spark: SparkSession, root: str) -> DataFrame:
    """(path, blob_sha, content) of a worktree's files. The driver lists paths only; executors, which must see ``root``,
    read each file once. (Spark's own file reader leaves out empty files and names with a leading dot.)"""
    paths, _ = listed(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                try:
                    yield pd.DataFrame({"path": [path], "content": [(Path(root) / path).read_bytes()]})
                except OSError as error:
                    raise ScanRejected(str(error)) from error

    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    files = rows.repartition(spark.sparkContext.defaultParallelism).mapInPandas(read, "path string, content binary")
    return files.select("path", git_sha(F.col("content")).alias("blob_sha"), "content")


def git_tree(spark: SparkSession, root: str, commit: str = "HEAD") -> DataFrame:
    """(path, blob_sha, executable) of a commit's blobs, as git lists them."""
    done = subprocess.run(["git", "-C", root, "ls-tree", "-r", "-z", commit], capture_output=True, check=False)
    if done.returncode:
        raise ScanRejected(done.stderr.decode(errors="replace"))
    return spark.createDataFrame(list(parse_tree(done.stdout)), "path string, blob_sha string, executable boolean")


def parse_tree(listing: bytes) -> Iterator[tuple[str, str, bool]]:
    for line in listing.split(b"\x00"):
        if line:
            head, _, path = line.partition(b"\t")
            mode, kind, sha = head.decode().split(" ")
            if kind == "blob" and mode != "120000":
                yield path.decode(errors="replace"), sha, mode == "100755"


def read_blobs(root: str, shas: list[str]) -> Iterator[tuple[str, bytes | None]]:
    """Contents of blobs by id from a repository; ids that are no 40 hex digits are refused, missing ones are None."""
    for sha in shas:
        if len(sha) != 40 or set(sha) - set("0123456789abcdef"):
            raise ValueError(sha)
        done = subprocess.run(["git", "-C", root, "cat-file", "blob", sha], capture_output=True, check=False)
        yield sha, done.stdout if not done.returncode else None


def read_batch(root: str, shas: list[str]) -> Iterator[bytes]:
    """Contents of blobs by id, in order, from one git process. A blob that is not there rejects the scan."""
    if any(len(sha) != 40 or set(sha) - set("0123456789abcdef") for sha in shas):
        raise ValueError("not a blob id")
    done = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input="".join(f"{sha}\n" for sha in shas).encode(), capture_output=True, check=False)
    out, at = done.stdout, 0
    for sha in shas:
        stop = out.find(b"\n", at)
        head = out[at:stop].split()
        if len(head) != 3 or head[1] != b"blob":
            raise ScanRejected(f"{sha}: {out[at:stop].decode(errors='replace')}")
        at = stop + 1 + int(head[2])
        yield out[stop + 1 : at]
        at += 1


def verified(contents: DataFrame) -> DataFrame:
    """Contents (blob_sha, content) whose bytes hash to their id."""
    return contents.filter(F.col("blob_sha") == git_sha(F.col("content")))


def publish(tables: dict[str, DataFrame], root: str, snapshot: str) -> None:
    """Write a snapshot's fact tables, each in a folder of its own, and its pointer last: readers see all of it or none."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/facts/{snapshot}/{name}")
    spark.createDataFrame([(snapshot, sorted(tables))], "snapshot string, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{root}/published/{snapshot}")


def published(spark: SparkSession, root: str, snapshot: str) -> dict[str, DataFrame]:
    """The tables of a published snapshot; LookupError for one that is not (wholly) there."""
    try:
        names = spark.read.json(f"{root}/published/{snapshot}").first()["tables"]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        raise LookupError(snapshot) from error
    return {n: spark.read.parquet(f"{root}/facts/{snapshot}/{n}") for n in names}
