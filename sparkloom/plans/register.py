"""Registration: from a worktree and its commit to fact tables, manifests and anchors that every query verb reads.

A store is a folder. Facts are addressed by content: a registration parses only units (blob, parser) that are new or have another
parser revision, and writes them as a generation of their own; a unit's row in ``blobs`` names the generation that holds its facts.
A pointer file, written last, names what readers see: they see all of a registration or nothing of it.

``blobs`` and ``manifest_entries`` are logs: a registration adds what it changes. Of a unit the row of the latest generation counts, and one without a revision says that it is gone; entries
of manifests that are gone are not seen. ``compact`` writes what is live anew, sorted by the names of lookups and in the layouts of ``layouts.SECOND``; a registration does so every ``COMPACT_AFTER`` generations. Facts
that are newer than a layout are added to it as it is read. Whether a snapshot is the one before is told by fingerprints, kept with the manifests.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import language_of
from sparkloom.operators import admin, extract, resolution
from sparkloom.plans import snapshots
from sparkloom.plans.layouts import SECOND, made
from sparkloom.sources import worktree
from sparkloom.sources.shared import small_batches

#: Of each parser; facts of another revision are made anew.
REVISION = 1
UNIT = "blob_sha string, parser_id string"
SCHEMAS = {
    "symbols": f"id long, {UNIT}, parent_id long, name string, qualified string, kind string, signature string, visibility string, doc string, byte_start long, byte_end long, line_start long, line_end long, source string, scope string, generation long",
    "refs": f"id long, {UNIT}, enclosing_id long, target_name string, target_qualified string, kind string, role string, byte_start long, byte_end long, line long, source string, generation long",
    "implementations": f"id long, {UNIT}, type_qualified string, interface_qualified string, kind string, line long, syntactic_kind string, interface_byte_start long, interface_byte_end long, generation long",
    "imports": f"id long, {UNIT}, to_module string, imported string, alias string, is_reexport boolean, line long, byte_start long, byte_end long, generation long",
    "resolutions": "id long, site_blob_sha string, site_parser_id string, site_byte_start long, site_byte_end long, kind string, semantic_kind string, target_symbol_id long, source string, target_path string, manifest_id long, generation long",
    "errors": f"{UNIT}, name string, doc string, generation long",
    "blobs": f"{UNIT}, parser_revision int, parsed_at_ns long, analyzer_id string, analyzer_revision int, generation long",
    "manifests": "manifest_id long, kind string, commit_sha string, built_at_ns long, fingerprint string",
    "manifest_entries": "manifest_id long, path string, blob_sha string",
    "anchors": "anchor_name string, manifest_id long, last_updated_ns long, reconcile_generation long",
}
#: Tables that generations add to; the others are small and written whole.
LOGS = ("blobs", "manifest_entries")
#: Order of compacted tables.
ORDER = {
    "symbols": ("qualified", "id"), "refs": ("target_name", "id"), "implementations": ("interface_qualified", "id"), "imports": ("blob_sha", "id"),
    "resolutions": ("site_blob_sha", "site_byte_start", "id"), "errors": ("blob_sha", "parser_id"), "blobs": ("blob_sha", "parser_id"), "manifest_entries": ("manifest_id", "path"),
}
COMPACT_AFTER = 16
#: Contents that are sent to Python at once.
BATCH_BYTES = 4 << 20
FACTS = ("symbols", "refs", "implementations", "imports", "resolutions", "errors")


@dataclass
class Outcome:
    committed_manifest: int | None
    tentative_manifest: int
    blobs_parsed: int
    reused: bool
    generation: int


def identified(rows: DataFrame, generation: int) -> DataFrame:
    """An extractor's rows with their ids. Those are hashes of unit, fact and place, so that equal content has equal ids in every registration."""
    place = ["fact", "kind", "qualified", "name", "target", "target_qualified", "byte_start", "byte_end", "line_start"]
    return rows.withColumn("id", F.xxhash64("blob_sha", "parser_id", *place)).withColumn("generation", F.lit(generation).cast("long")).dropDuplicates(["blob_sha", "parser_id", "id"])


def fact_tables(rows: DataFrame, generation: int) -> dict[str, DataFrame]:
    """Fact tables of rows with ids. Each reads the rows, which are therefore to be kept."""
    of = lambda fact: rows.filter(F.col("fact") == fact)
    symbols = of("symbol")
    parents = symbols.groupBy("blob_sha", "parser_id", F.col("qualified").alias("parent")).agg(F.min_by("id", F.struct("byte_start", "id")).alias("parent_id"))
    symbols = symbols.join(parents, ["blob_sha", "parser_id", "parent"], "left").withColumn("source", F.lit("tier1"))
    refs = extract.with_enclosing_ids(of("ref"), symbols).withColumns({"target_name": F.col("target"), "line": F.col("line_start"), "source": F.lit("tier2")})
    bases = of("implementation").select(
        "id", "blob_sha", "parser_id", F.col("qualified").alias("type_qualified"), F.coalesce("target_qualified", "target").alias("interface_qualified"), "kind", F.col("line_start").alias("line"),
        F.col("role").alias("syntactic_kind"), F.col("byte_start").alias("interface_byte_start"), F.col("byte_end").alias("interface_byte_end"), "generation",
    )
    imports = of("import").select(
        "id", "blob_sha", "parser_id", F.col("target").alias("to_module"), F.col("name").alias("imported"), "alias", F.lit(False).alias("is_reexport"), F.col("line_start").alias("line"), "byte_start", "byte_end", "generation"
    )
    direct = resolution.direct_resolutions(bases, language_of(F.col("parser_id"))).withColumn("generation", F.lit(generation).cast("long"))
    made = {"symbols": symbols, "refs": refs, "implementations": bases, "imports": imports, "resolutions": direct, "errors": of("error")}
    return {n: shaped(df, n) for n, df in made.items()}


def shaped(df: DataFrame, name: str) -> DataFrame:
    """A table's columns and types, in order."""
    return df.select(*[F.col(c.rsplit(" ", 1)[0]).cast(c.rsplit(" ", 1)[1]) for c in SCHEMAS[name].split(", ")])


class Store:
    """A folder of fact tables with a pointer to what is published. Attributes are the tables, so that query verbs take a store as facts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.live = self._pointer()

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _pointer(self) -> dict:
        fs, at = self._fs(f"{self.root}/published")
        if not fs.exists(at):
            return {"generation": 0, "tables": {}}
        latest = max(int(s.getPath().getName()) for s in fs.listStatus(at))
        return json.loads(self.spark.read.text(f"{self.root}/published/{latest}").first()[0])

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def __getattr__(self, name: str) -> DataFrame:
        if name in SECOND:
            return self._live(self._layout(name))
        if name not in SCHEMAS:
            raise AttributeError(name)
        paths = self.live["tables"].get(name, [])
        df = self._read(name, paths)
        if name in FACTS:
            return self._live(df)
        if name == "blobs" and len(paths) > 1:
            rest = [c for c in df.columns if c not in ("blob_sha", "parser_id")]
            last = df.groupBy("blob_sha", "parser_id").agg(F.max_by(F.struct(*rest), "generation").alias("_last"))
            df = last.select("blob_sha", "parser_id", "_last.*").select(*df.columns)
        if name == "blobs":
            return df.filter("parser_revision IS NOT NULL")
        if name == "manifest_entries" and self.live.get("removed"):
            return df.join(self.manifests.select("manifest_id"), "manifest_id", "left_semi")
        return df

    def _live(self, df: DataFrame) -> DataFrame:
        """Facts without those of units that were parsed again or pruned. As long as no unit ever was, these are all."""
        if not self.live.get("dead"):
            return df
        unit = ["site_blob_sha", "site_parser_id"] if "site_blob_sha" in df.columns else ["blob_sha", "parser_id"]
        live = self.blobs.select(F.col("blob_sha").alias(unit[0]), F.col("parser_id").alias(unit[1]), "generation")
        return df.join(live, [*unit, "generation"], "left_semi").select(*df.columns)

    def _layout(self, name: str) -> DataFrame:
        """A layout as it was compacted, and the facts that came later."""
        table = SECOND[name][0]
        done = self.live.get("layouts", {}).get(name)
        paths = self.live["tables"].get(table, [])
        if done is None:
            return made(name, self._read(table, paths))
        newer = made(name, self._read(table, [p for p in paths if p != done["of"]]))
        old = self.spark.read.schema(newer.schema).parquet(done["path"])
        return old if paths == [done["of"]] else old.unionByName(newer)

    def _write(self, df: DataFrame, name: str, n: int, order: tuple[str, ...] = ()) -> str:
        path = f"{self.root}/{name}/{n}"
        df = df.hint("rebalance", order[0]).sortWithinPartitions(*order) if order else df
        df.write.mode("overwrite").parquet(path)  # of a registration that failed before its pointer
        return path

    def publish(self, added: dict[str, DataFrame], state: dict[str, DataFrame], **more) -> int:
        """Write a generation: ``added`` goes to facts and logs, ``state`` tables take the place of what they were. The pointer comes last, with what else it is to hold."""
        n = self.live["generation"] + 1
        tables = dict(self.live["tables"])
        for name, df in added.items():
            tables[name] = [*tables.get(name, []), self._write(df, name, n, ORDER[name])]
        for name, df in state.items():
            tables[name] = [self._write(df, name, n)]
        return self._point(n, tables, **more)

    def _point(self, n: int, tables: dict[str, list[str]], **more) -> int:
        live = {**self.live, **more, "generation": n, "tables": tables}
        fs, at = self._fs(f"{self.root}/published/{n}")
        if fs.exists(at):
            raise RuntimeError(f"generation {n} was published meanwhile")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(live).encode()))
        out.close()
        self.live = live
        return n

    def compact(self) -> int:
        """Write what is live as one sorted table each, and the layouts. Readers of older pointers keep the files they name."""
        n = self.live["generation"] + 1
        tables = dict(self.live["tables"])
        for name in (*FACTS, *LOGS):
            tables[name] = [self._write(getattr(self, name), name, n, ORDER[name])]
        layouts = {}
        for name, (table, order, _) in SECOND.items():
            rows = made(name, self._read(table, tables[table]))
            layouts[name] = {"of": tables[table][0], "path": self._write(rows, name, n, order)}
        return self._point(n, tables, layouts=layouts, removed=False, dead=False)

    def vacuum(self) -> int:
        """Delete files that the latest pointer does not name; readers of older pointers lose theirs. Returns how many generations of tables went."""
        named = {p for paths in self.live["tables"].values() for p in paths} | {x["path"] for x in self.live.get("layouts", {}).values()}
        gone = 0
        for name in (*SCHEMAS, *SECOND):
            fs, at = self._fs(f"{self.root}/{name}")
            for s in fs.listStatus(at) if fs.exists(at) else ():
                if f"{self.root}/{name}/{s.getPath().getName()}" not in named:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone


def fingerprint(entries: DataFrame) -> str:
    """Of the files (path, blob_sha) of a snapshot, whatever their order: their number and sums of two hashes of each. Added up in parts, so nothing is shuffled but those."""
    sums = [F.sum(F.xxhash64(*x).cast("decimal(38,0)")) for x in (("path", "blob_sha"), (F.lit(1), "blob_sha", "path"))]
    return ":".join(str(x or 0) for x in entries.agg(F.count(F.lit(1)), *sums).first())


def with_parsers(files: DataFrame) -> DataFrame:
    """Files (path, blob_sha, content) that some parser takes, with its id."""
    return files.withColumn("language", extract.dispatched(F.col("path"), F.col("content"))).filter("language IS NOT NULL").withColumn("parser_id", extract.parser_id(F.col("language"))).drop("language")


def left_to_parse(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Distinct units of files (with parsers) whose facts are not stored in the current revision, with their content."""
    none = [F.lit(None).cast("string").alias("analyzer_id"), F.lit(None).cast("int").alias("analyzer_revision")]
    units = files.select("blob_sha", "parser_id", F.lit(REVISION).alias("parser_revision"), *none, "content")
    have = blobs.select("blob_sha", "parser_id", "parser_revision", *none)
    return admin.to_parse(units, have)


def register_files(store: Store, files: DataFrame, anchor: str, now_ns: int, commit: str | None = None, committed: DataFrame | None = None, branch: str | None = None, generation: int | None = None, force: bool = False) -> Outcome:
    """Register captured files (path, blob_sha, content) under a tentative anchor, and those of a commit under HEAD and its branch.

    An unchanged tentative snapshot keeps its manifest unless ``force`` asks for a new one; a commit that is known keeps its own. All of it is published at once."""
    with small_batches(store.spark, maxBytesPerBatch=BATCH_BYTES):
        return _registered(store, files, anchor, now_ns, commit, committed, branch, generation, force)


def _registered(store: Store, files: DataFrame, anchor: str, now_ns: int, commit: str | None, committed: DataFrame | None, branch: str | None, generation: int | None, force: bool) -> Outcome:
    kept = with_parsers(files).persist()
    own = None if committed is None else with_parsers(committed)
    todo = left_to_parse(kept if own is None else kept.unionByName(own), store.blobs).persist()
    found: list[DataFrame] = []
    try:
        n = store.live["generation"] + 1
        parsed = todo.count()
        found.append(identified(extract.extract_units(todo), n).persist())  # contents are parsed once, not for each table
        facts = fact_tables(found[-1], n)
        again = todo.join(store.blobs.select("blob_sha", "parser_id"), ["blob_sha", "parser_id"], "left_semi")
        dead = bool(store.live.get("dead")) or not again.isEmpty()
        blobs = shaped(todo.select("*", F.lit(now_ns).alias("parsed_at_ns"), F.lit(n).alias("generation")), "blobs")
        manifests, anchors = store.manifests, store.anchors
        last = manifests.agg(F.max("manifest_id")).first()[0] or 0
        known = None if commit is None else manifests.filter(F.col("commit_sha") == commit).select("manifest_id").first()
        rows, more = [], []
        at_head = known[0] if known else None
        if commit is not None and known is None:
            last += 1
            at_head = last
            rows.append((at_head, "committed", commit, now_ns, fingerprint(own.select("path", "blob_sha"))))
            more.append(own.select(F.lit(at_head).cast("long").alias("manifest_id"), "path", "blob_sha"))
        prior = anchors.filter(F.col("anchor_name") == anchor).select("manifest_id").first()
        new = kept.select("path", "blob_sha")
        mark, reused = fingerprint(new), False
        if prior is not None and not force:
            before = manifests.filter(F.col("manifest_id") == prior[0]).select("fingerprint").first()
            reused = before is not None and before[0] == mark
        tentative = prior[0] if reused else last + 1
        if not reused:
            rows.append((tentative, "tentative", None, now_ns, mark))
            more.append(new.select(F.lit(tentative).cast("long").alias("manifest_id"), "path", "blob_sha"))
        if rows:
            manifests = manifests.unionByName(store.spark.createDataFrame(rows, SCHEMAS["manifests"]))
        for name, manifest in (("HEAD", at_head), (f"branch/{branch}" if branch else None, at_head), (anchor, tentative)):
            if name is not None and manifest is not None:
                anchors = snapshots.upsert_anchor(anchors, name, manifest, now_ns, generation if name == anchor else None)
        added = {**facts, "blobs": blobs} if parsed else {}
        if more:
            added["manifest_entries"] = reduce(lambda a, b: a.unionByName(b), more)
        done = store.publish(added, {"manifests": manifests, "anchors": anchors}, dead=dead)
        if max(map(len, store.live["tables"].values())) > COMPACT_AFTER:
            done = store.compact()
        return Outcome(at_head, tentative, parsed, reused, done)
    finally:
        for df in (kept, todo, *found):
            df.unpersist()


def git(root: str, *arguments: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, check=False)
    return None if done.returncode else done.stdout.decode(errors="replace").strip()


def committed_files(spark: SparkSession, root: str, commit: str) -> DataFrame:
    """(path, blob_sha, content) of a commit. Executors, which must see ``root``, read the blobs of a partition from one git process."""
    tree = worktree.git_tree(spark, root, commit).select("path", "blob_sha")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(content=list(worktree.read_batch(root, b["blob_sha"].tolist())))

    return tree.repartition(spark.sparkContext.defaultParallelism).mapInPandas(read, "path string, blob_sha string, content binary")


def register_repo(store: Store, root: str, now_ns: int, worktree_id: int = 1, generation: int | None = None, force: bool = False) -> Outcome:
    """Register a worktree: its commit under HEAD and its branch, its files as they are under ``tentative/<id>``. Anchors of branches and tags that are gone go."""
    commit = git(root, "rev-parse", "HEAD")
    if commit is None:
        raise ValueError(f"no commit in {root}")
    branch = git(root, "symbolic-ref", "--short", "-q", "HEAD")
    files = worktree.worktree(store.spark, root)
    done = register_files(store, files, f"tentative/{worktree_id}", now_ns, commit, committed_files(store.spark, root, commit), branch, generation, force)
    refs = (git(root, "for-each-ref", "--format=%(refname)", "refs/heads", "refs/tags") or "").split()
    live = [(r.replace("refs/heads/", "branch/", 1).replace("refs/tags/", "tag/", 1),) for r in refs]
    live = store.spark.createDataFrame(live, "anchor_name string")
    if admin.prune_stale_refs(store.anchors, live).count() < store.anchors.count():
        done.generation = store.publish({}, {"anchors": admin.prune_stale_refs(store.anchors, live)})
    return done


def remove_anchors(store: Store, names: list[str]) -> int:
    """Take snapshots back: their anchors go, and manifests, entries and blobs that no anchor leads to. Facts of those blobs are not seen any more."""
    anchors = store.anchors.filter(~F.col("anchor_name").isin(*names))
    live = anchors.select("manifest_id").distinct()
    entries = store.manifest_entries.join(live, "manifest_id", "left_semi")
    gone = store.blobs.join(entries.select("blob_sha").distinct(), "blob_sha", "left_anti").withColumns({"parser_revision": F.lit(None), "generation": F.lit(store.live["generation"] + 1)})
    return store.publish({"blobs": shaped(gone, "blobs")}, {"anchors": anchors, "manifests": store.manifests.join(live, "manifest_id", "left_semi")}, removed=True, dead=True)
