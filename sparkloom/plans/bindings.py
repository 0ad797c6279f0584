"""Fact tables made from the driver's relational tables.

The tables hold no source code, so each fact table is derived from them by a fixed rule, written in SQL that Spark and
DuckDB read alike. ``bind`` gives DataFrames; ``with_clause`` the same text as common table expressions for an oracle query.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sparkloom.plans.layouts import SECOND, made
from sparkloom.sources.shared import new_path

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels")

#: Fact tables in order of dependency; {name} stands for a table.
BINDINGS = {
    "manifests": """
SELECT CAST(r_regionkey AS BIGINT) AS manifest_id,
       CASE WHEN r_regionkey % 2 = 0 THEN 'committed' ELSE 'tentative' END AS kind,
       CASE WHEN r_regionkey % 2 = 0 THEN 'c' || r_name END AS commit_sha,
       CAST(r_regionkey AS BIGINT) * 1000000000 AS built_at_ns
FROM {region}""",
    "anchors": """
SELECT 'HEAD' AS anchor_name, CAST(0 AS BIGINT) AS manifest_id, CAST(5 AS BIGINT) AS last_updated_ns, CAST(NULL AS BIGINT) AS reconcile_generation
UNION ALL SELECT 'branch/' || r_name, CAST(r_regionkey AS BIGINT), CAST(r_regionkey * 10 AS BIGINT), NULL FROM {region}
UNION ALL SELECT 'tag/v' || CAST(r_regionkey AS STRING), CAST(r_regionkey AS BIGINT), CAST(r_regionkey * 7 AS BIGINT), NULL FROM {region} WHERE r_regionkey % 2 = 0
UNION ALL SELECT 'tentative/' || CAST(r_regionkey AS STRING), CAST(r_regionkey AS BIGINT), CAST(r_regionkey * 20 AS BIGINT), CAST(r_regionkey + 3 AS BIGINT) FROM {region} WHERE r_regionkey % 2 = 1""",
    "manifest_entries": """
SELECT CAST(n_regionkey AS BIGINT) AS manifest_id,
       'src/n' || CAST(n_nationkey AS STRING) || CASE WHEN s_suppkey % 3 = 0 THEN '/deep' ELSE '' END || '/s' || CAST(s_suppkey AS STRING) || '.py' AS path,
       'b' || CAST(s_suppkey AS STRING) AS blob_sha
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL
SELECT CAST(0 AS BIGINT), 'Shared/s' || CAST(s_suppkey AS STRING) || '.py', 'b' || CAST(s_suppkey AS STRING) FROM {supplier}""",
    "blobs": """
SELECT 'b' || CAST(s_suppkey AS STRING) AS blob_sha,
       CASE s_suppkey % 4 WHEN 0 THEN 'tree-sitter-python' WHEN 1 THEN 'tree-sitter-rust@2' WHEN 2 THEN 'tree-sitter-java' ELSE 'markdown' END AS parser_id,
       CAST(1 + s_suppkey % 3 AS INT) AS parser_revision,
       CAST(s_suppkey AS BIGINT) * 1000 AS parsed_at_ns,
       CASE WHEN s_suppkey % 3 <> 0 THEN 'analyzer-' || CAST(s_suppkey % 4 AS STRING) END AS analyzer_id,
       CASE WHEN s_suppkey % 3 <> 0 THEN CAST(1 + s_suppkey % 2 AS INT) END AS analyzer_revision
FROM {supplier}
UNION ALL
SELECT 'b' || CAST(s_suppkey AS STRING), 'tree-sitter-typescript', CAST(1 AS INT), CAST(s_suppkey AS BIGINT) * 1000, 'analyzer-ts', CAST(1 AS INT) FROM {supplier} WHERE s_suppkey % 10 = 0""",
    "symbols": """
SELECT CAST(p.p_partkey AS BIGINT) AS id, b.blob_sha, b.parser_id,
       CASE WHEN p.p_partkey >= k.n AND p.p_partkey % 3 = 0 THEN CAST(p.p_partkey - k.n AS BIGINT) END AS parent_id,
       replace(p.p_name, ' ', '_') AS name,
       replace(p.p_brand, '#', '') || CASE p.p_partkey % 3 WHEN 0 THEN '::' WHEN 1 THEN '.' ELSE chr(92) END || replace(p.p_name, ' ', '_') AS qualified,
       CASE p.p_type WHEN 'ECONOMY' THEN 'function' WHEN 'SMALL' THEN 'class' WHEN 'MEDIUM' THEN 'method' WHEN 'PROMO' THEN 'test' WHEN 'STANDARD' THEN 'interface' ELSE 'struct' END AS kind,
       CASE WHEN p.p_size % 4 <> 0 THEN 'def ' || p.p_name END AS signature,
       CASE p.p_size % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'crate' WHEN 2 THEN 'private' END AS visibility,
       CASE WHEN p.p_partkey % 5 <> 0 THEN 'A ' || lower(p.p_type) || ' part: ' || p.p_name || ', made by ' || p.p_brand END AS doc,
       CAST(((p.p_partkey - p.p_partkey % k.n) / k.n) * 60 AS BIGINT) AS byte_start,
       CAST(((p.p_partkey - p.p_partkey % k.n) / k.n) * 60 + p.p_size * 5 AS BIGINT) AS byte_end,
       CAST(((p.p_partkey - p.p_partkey % k.n) / k.n) * 6 + 1 AS BIGINT) AS line_start,
       CAST(((p.p_partkey - p.p_partkey % k.n) / k.n) * 6 + 1 + p.p_size AS BIGINT) AS line_end,
       'tier1' AS source,
       CASE WHEN p.p_partkey % 7 = 0 THEN 'nested' ELSE 'top_level' END AS scope
FROM {part} p CROSS JOIN (SELECT count(*) AS n FROM {supplier}) k
JOIN {blobs} b ON b.blob_sha = 'b' || CAST(p.p_partkey % k.n AS STRING) AND b.parser_id <> 'tree-sitter-typescript'""",
    "refs": """
SELECT CAST(l.l_orderkey AS BIGINT) * 1024 + row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate) AS id,
       'b' || CAST(l.l_suppkey AS STRING) AS blob_sha,
       CASE l.l_suppkey % 4 WHEN 0 THEN 'tree-sitter-python' WHEN 1 THEN 'tree-sitter-rust@2' WHEN 2 THEN 'tree-sitter-java' ELSE 'markdown' END AS parser_id,
       CASE WHEN l.l_linenumber % 4 <> 0 THEN CAST(l.l_partkey - l.l_partkey % k.n + l.l_suppkey AS BIGINT) END AS enclosing_id,
       replace(p.p_name, ' ', '_') AS target_name,
       CASE l.l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN replace(p.p_brand, '#', '') || CASE p.p_partkey % 3 WHEN 0 THEN '::' WHEN 1 THEN '.' ELSE chr(92) END || replace(p.p_name, ' ', '_') ELSE '' END AS target_qualified,
       CASE WHEN l.l_returnflag = 'A' THEN 'call' WHEN l.l_returnflag = 'R' THEN 'import' WHEN l.l_linestatus = 'O' THEN 'type' ELSE 'instantiate' END AS kind,
       CASE WHEN l.l_linenumber = 7 THEN CAST(0 AS BIGINT) ELSE CAST(l.l_orderkey % 50 * 20 AS BIGINT) END AS byte_start,
       CASE WHEN l.l_linenumber = 7 THEN CAST(0 AS BIGINT) ELSE CAST(l.l_orderkey % 50 * 20 + 8 AS BIGINT) END AS byte_end,
       CAST(l.l_orderkey % 50 + 1 AS BIGINT) AS line,
       CASE (l.l_orderkey + l.l_linenumber) % 5 WHEN 0 THEN 'tier3-pyright' WHEN 1 THEN 'tier25-python' WHEN 2 THEN 'rust-syn' ELSE 'tier2' END AS source
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey CROSS JOIN (SELECT count(*) AS n FROM {supplier}) k""",
    "implementations": """
SELECT CAST(c_custkey AS BIGINT) AS id, b.blob_sha, b.parser_id,
       'T' || CAST(c_custkey % 40 AS STRING) AS type_qualified,
       CASE WHEN c_custkey % 11 <> 0 THEN 'I' || c_mktsegment END AS interface_qualified,
       CASE c_custkey % 4 WHEN 0 THEN 'inherit' WHEN 1 THEN 'implement' WHEN 2 THEN 'trait' ELSE 'include' END AS kind,
       CAST(c_custkey % 90 + 1 AS BIGINT) AS line,
       CASE c_custkey % 3 WHEN 0 THEN 'extends' WHEN 1 THEN 'implements' END AS syntactic_kind,
       CASE WHEN c_custkey % 4 <> 3 THEN CAST(c_custkey * 20 AS BIGINT) END AS interface_byte_start,
       CASE WHEN c_custkey % 4 <> 3 THEN CAST(c_custkey * 20 + 9 AS BIGINT) END AS interface_byte_end
FROM {customer} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) k
JOIN {blobs} b ON b.blob_sha = 'b' || CAST(c_custkey % k.n AS STRING) AND b.parser_id <> 'tree-sitter-typescript'""",
    "imports": """
SELECT CAST(o_orderkey AS BIGINT) AS id, b.blob_sha, b.parser_id,
       'mod_' || lower(replace(substr(o_orderpriority, 3), ' ', '_')) AS to_module,
       CASE WHEN o_orderkey % 3 <> 0 THEN 'name' || CAST(o_orderkey % 17 AS STRING) END AS imported,
       CASE WHEN o_orderkey % 5 = 0 THEN 'alias' || CAST(o_orderkey % 7 AS STRING) END AS alias,
       o_orderstatus = 'P' AS is_reexport,
       CAST(o_orderkey % 70 + 1 AS BIGINT) AS line,
       CASE WHEN o_orderkey % 6 <> 5 THEN CAST(o_orderkey * 30 AS BIGINT) END AS byte_start,
       CASE WHEN o_orderkey % 6 <> 5 THEN CAST(o_orderkey * 30 + 12 AS BIGINT) END AS byte_end
FROM {orders} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) k
JOIN {blobs} b ON b.blob_sha = 'b' || CAST(o_custkey % k.n AS STRING) AND b.parser_id <> 'tree-sitter-typescript'""",
    "resolutions": """
SELECT CAST(s.id * 10 + t.k AS BIGINT) AS id, s.site_blob_sha, s.site_parser_id, s.site_byte_start, s.site_byte_end, s.kind,
       CASE WHEN s.kind = 'type' AND s.id % 4 <> 0 THEN CASE (s.id + t.k) % 3 WHEN 0 THEN 'inherit' WHEN 1 THEN 'implement' ELSE 'mixin' END END AS semantic_kind,
       CASE WHEN (s.id + t.k) % 3 <> 0 THEN CAST((s.id * 7 + t.k) % m.n AS BIGINT) END AS target_symbol_id,
       CASE (s.id + t.k) % 4 WHEN 0 THEN 'tier3-pyright' WHEN 1 THEN 'tier25-python' WHEN 2 THEN 'tier2-direct-rust' ELSE 'rust-syn' END AS source,
       CASE WHEN s.id % 2 = 0 THEN 'Shared/s' || CAST(s.id % k.n AS STRING) || '.py' END AS target_path,
       CASE WHEN t.k = 0 THEN CAST(NULL AS BIGINT) ELSE CAST((s.id + t.k) % 5 AS BIGINT) END AS manifest_id
FROM (
  SELECT id * 3 AS id, blob_sha AS site_blob_sha, parser_id AS site_parser_id, byte_start AS site_byte_start, byte_end AS site_byte_end, kind FROM {refs} WHERE kind IN ('call', 'type', 'import') AND id % 3 <> 1
  UNION ALL SELECT id * 3 + 1, blob_sha, parser_id, interface_byte_start, interface_byte_end, 'type' FROM {implementations} WHERE interface_byte_start IS NOT NULL AND id % 5 <> 0
  UNION ALL SELECT id * 3 + 2, blob_sha, parser_id, byte_start, byte_end, 'import' FROM {imports} WHERE byte_start IS NOT NULL AND id % 4 <> 0) s
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) t
CROSS JOIN (SELECT count(*) AS n FROM {supplier}) k
CROSS JOIN (SELECT count(*) AS n FROM {part}) m""",
    "runs": """
SELECT CAST(o_custkey % 7 AS BIGINT) AS manifest_id,
       'analyzer-' || CAST(o_orderkey AS STRING) AS analyzer_id,
       CAST(1 + o_orderkey % 3 AS INT) AS analyzer_revision,
       'cfg' || CAST(o_orderkey % 2 AS STRING) AS config_hash,
       CASE o_orderkey % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' WHEN 4 THEN 'skipped' WHEN 5 THEN 'cancelled' ELSE 'timed_out' END AS status,
       CAST(o_orderkey AS BIGINT) * 1000000 AS started_at_ns,
       CASE WHEN o_orderkey % 7 >= 2 THEN CAST(o_orderkey AS BIGINT) * 1000000 + CAST(o_custkey AS BIGINT) * 3000000 END AS finished_at_ns,
       CASE o_orderkey % 7 WHEN 3 THEN 'server exited' WHEN 6 THEN 'stall: no progress for 300 s' END AS error,
       CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey AS BIGINT) END AS job_id,
       o_orderkey % 7 = 5 AS cancel_requested
FROM {orders}""",
    "analyzers": """
SELECT 'tree-sitter-python' AS parser_id, 'analyzer-0' AS analyzer_id
UNION ALL SELECT 'tree-sitter-rust@2', 'analyzer-9'
UNION ALL SELECT 'tree-sitter-java', CAST(NULL AS STRING)
UNION ALL SELECT 'tree-sitter-typescript', 'analyzer-ts'""",
    "aliases": """
SELECT 'repo-' || CAST(n_nationkey AS STRING) AS alias, 'h' || CAST(n_nationkey % 20 AS STRING) AS repo_hash, CAST(n_nationkey AS BIGINT) AS registered_at_ns FROM {nation}""",
    "repositories": """
SELECT 'h' || CAST(n_nationkey AS STRING) AS repo_hash,
       '/work/r' || CAST(n_regionkey AS STRING) || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '/nested' END || '/' || lower(n_name) AS root_path,
       CAST(n_nationkey AS BIGINT) * 10 AS registered_at_ns, CAST(n_regionkey AS BIGINT) AS manifest_id
FROM {nation}""",
    "repo_anchors": """
SELECT 'h' || CAST(n_nationkey AS STRING) AS repo_hash, 'HEAD' AS anchor_name, CAST(n_regionkey AS BIGINT) AS manifest_id FROM {nation} WHERE n_nationkey <> 13
UNION ALL SELECT 'h' || CAST(n_nationkey AS STRING), 'branch/main', CAST(n_regionkey AS BIGINT) FROM {nation} WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'h' || CAST(n_nationkey AS STRING), 'branch/dev', CAST((n_regionkey + 1) % 5 AS BIGINT) FROM {nation} WHERE n_nationkey % 3 = 0
UNION ALL SELECT 'h' || CAST(n_nationkey AS STRING), 'tag/v1', CAST((n_regionkey + 2) % 7 AS BIGINT) FROM {nation} WHERE n_nationkey % 4 = 3""",
    "watched": """
SELECT 'c' || CAST(c_custkey AS STRING) AS repo_hash, CASE WHEN c_custkey % 19 = 3 THEN CAST(c_custkey AS BIGINT) * 5 END AS removal_requested_at_ns
FROM {customer} WHERE c_custkey % 23 <> 4""",
    "reconcile_state": """
SELECT 'c' || CAST(c_custkey AS STRING) AS repo_hash,
       CAST(c_custkey % 9 + 1 AS BIGINT) AS desired,
       CAST(c_custkey % 9 + 1 - CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS applied,
       CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 9 + 1 AS BIGINT) END AS attempt,
       CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey AS BIGINT) * 1000000000 END AS last_success_ns,
       CAST(c_custkey % 8 AS BIGINT) AS consecutive_failures,
       CASE c_custkey % 7 WHEN 0 THEN 'inactive' WHEN 1 THEN 'failed' ELSE 'active' END AS watcher_state,
       CASE WHEN c_custkey % 13 = 0 THEN 'overflow' END AS watcher_error,
       CASE WHEN c_custkey % 10 = 9 THEN 'HEAD' ELSE 'tentative/' || CAST(c_nationkey AS STRING) END AS anchor_name,
       CASE WHEN c_custkey % 12 <> 0 THEN CAST(c_custkey % 9 + 1 - CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS BIGINT) END AS reconcile_generation
FROM {customer}""",
}


def needs(name: str) -> list[str]:
    """Fact tables that a text refers to, with those they are made from, in order."""
    text = BINDINGS.get(name, name)
    direct = {x for x in re.findall(r"\{(\w+)\}", text) if x in BINDINGS}
    found = set(direct)
    for x in direct:
        found |= set(needs(x))
    return [x for x in BINDINGS if x in found]


def with_clause(*names: str) -> str:
    """WITH and the named fact tables and all they need, for an oracle query."""
    wanted = {x for n in names for x in [n, *needs(n)]}
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', BINDINGS[n])})" for n in BINDINGS if n in wanted)


#: Large fact tables are written once in a session, in the order in which they are looked up: row groups and files outside of a name are skipped.
LAYOUT = {
    "symbols": ("qualified", "id"),
    "refs": ("target_name", "id"),
    "implementations": ("interface_qualified", "id"),
    "imports": ("blob_sha", "id"),
    "resolutions": ("site_blob_sha", "site_byte_start", "id"),
    "manifest_entries": ("manifest_id", "path"),
    "runs": ("manifest_id", "job_id"),
} | {name: columns for name, (_, columns, _) in SECOND.items()}
#: Bytes of a row group: a lookup reads few of them, a scan deals them to many tasks.
ROW_GROUP = 4 << 20
_WRITTEN: dict[tuple[str, str, str, bool], tuple[str, StructType]] = {}


#: Not written where they are asked for once or in a few passes: each row comes from one row of a table that is at hand.
VIEWS = ("implementations", "imports", "resolutions")
#: Tables whose second layouts are as large as the input.
LARGE = ("refs", "resolutions")


def for_spark(text: str, count: Callable[[str], int]) -> str:
    """A binding as Spark reads it best: numbers of rows as literals and small fixed lists as arrays, not as joins."""
    for table, alias in re.findall(r"CROSS JOIN \(SELECT count\(\*\) AS n FROM \{(\w+)\}\) (\w+)", text):
        text = text.replace(f"CROSS JOIN (SELECT count(*) AS n FROM {{{table}}}) {alias}", "")
        text = re.sub(rf"\b{alias}\.n\b", f"{count(table)}L", text)
    return text.replace("CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) t", "LATERAL VIEW explode(array(0, 1, 2)) t AS k")


class Facts:
    """Fact tables of a data folder, each made when it is first asked for.

    indexed: large tables are written in the order of their lookups, with their second layouts, which many lookups repay. A single query doesn't:
    without an index, ``refs`` is written once as it comes, what derives from a table row by row is derived as it is read, and lookups scan."""

    def __init__(self, spark: SparkSession, sf_dir: str, indexed: bool = True):
        self.spark, self.sf_dir, self.indexed = spark, sf_dir, indexed
        self.made: dict[str, DataFrame] = {}
        self.counts: dict[str, int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name in SECOND and not self.indexed and SECOND[name][0] in LARGE):
            raise AttributeError(name)
        if name not in self.made:
            if name in SECOND:
                self.made[name] = self.stored(name, lambda: made(name, getattr(self, SECOND[name][0])))
            elif name in BINDINGS:
                self.made[name] = self.stored(name, lambda: self.derived(name))
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    def derived(self, name: str) -> DataFrame:
        """A fact table, not written: for queries that read it once, and few of its columns."""
        text = for_spark(BINDINGS[name], self.count)
        used = dict.fromkeys(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{x: getattr(self, x) for x in used})

    def count(self, name: str) -> int:
        if name not in self.counts:
            self.counts[name] = getattr(self, name).count()
        return self.counts[name]

    def stored(self, name: str, make) -> DataFrame:
        """A fact table, read from where this session wrote it."""
        if name not in LAYOUT or (name in VIEWS and not self.indexed):
            return make()
        in_order = self.indexed or name not in LARGE
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name, in_order)
        if key not in _WRITTEN:
            path = new_path(self.spark, f"facts-{name}")
            df = make()
            # a name that many rows share is split over several files
            rows = df.hint("rebalance", LAYOUT[name][0]).sortWithinPartitions(*LAYOUT[name]) if in_order else df
            rows.write.option("parquet.block.size", ROW_GROUP).parquet(path)
            _WRITTEN[key] = (path, df.schema)
        path, schema = _WRITTEN[key]
        return self.spark.read.schema(schema).parquet(path)
