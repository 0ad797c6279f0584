"""Registered queries over the bound fact tables, each with its DuckDB twin.

``QUERIES`` maps a name to a function of ``Facts``; ``SQL`` maps it to the twin's text, which starts with the common
table expressions of the same bindings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fts, text
from sparkloom.functions.provenance import best_resolution, is_workspace_tier, source_rank
from sparkloom.operators import admin, enclosing, evaluate, lookup, repos, resolution
from sparkloom.plans import register, snapshots
from sparkloom.plans.bindings import Facts, with_clause
from sparkloom.sources.shared import new_path

QUERIES: dict[str, Callable[[Facts], DataFrame]] = {}
SQL: dict[str, str] = {}
HEAD = 0


def query(name: str, sql: str | None, *tables: str) -> Callable:
    def keep(f: Callable[[Facts], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            clause = with_clause(*tables) if tables else ""
            body = sql.strip()
            SQL[name] = f"{clause},\n{body[5:]}" if clause and body.startswith("WITH ") else f"{clause}\n{body}"
        return f

    return keep


LANGUAGE = "CASE WHEN starts_with({0}, 'tree-sitter-') THEN split_part(substr({0}, 13), '@', 1) ELSE {0} END"
#: Unicode white space.
SPACE = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
# Prefixes of sources, by rank.
RANK = """CASE WHEN starts_with({0}, 'tier3-') THEN 0 WHEN starts_with({0}, 'tier25-') THEN 1 WHEN starts_with({0}, 'tier2-direct-') THEN 2 WHEN {0} = 'rust-syn' THEN 3 ELSE 4 END"""
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BY_KIND = f"""best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY site_blob_sha, site_parser_id, site_byte_start, site_byte_end, kind
             ORDER BY CASE WHEN manifest_id = {HEAD} THEN 0 ELSE 1 END, {RANK.format("source")}, id) AS rn
    FROM resolutions WHERE kind IN ('type', 'call', 'import') AND (manifest_id = {HEAD} OR manifest_id IS NULL)) WHERE rn = 1)"""
FILES = f"e AS (SELECT path, blob_sha FROM manifest_entries WHERE manifest_id = {HEAD})"


def best_of(kind: str) -> str:
    return BY_KIND.replace("kind IN ('type', 'call', 'import')", f"kind = '{kind}'")


# ---- provenance

query("w1_best_resolution", f"WITH {BY_KIND} SELECT id, site_blob_sha, site_parser_id, site_byte_start, site_byte_end, kind, source, target_path, target_symbol_id FROM best", "resolutions")(
    lambda f: best_resolution(f.resolutions, HEAD).select("id", "site_blob_sha", "site_parser_id", "site_byte_start", "site_byte_end", "kind", "source", "target_path", "target_symbol_id")
)
query(
    "p11_source_rank",
    f"SELECT source, {RANK.format('source')} AS rank, (starts_with(source, 'tier3-') OR starts_with(source, 'tier25-')) AS workspace, count(*) AS n FROM refs GROUP BY source",
    "refs",
)(lambda f: f.derived("refs").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", source_rank(F.col("source")).alias("rank"), is_workspace_tier(F.col("source")).alias("workspace"), "n"))

# ---- symbols

SYMBOLS_SELECT = f"""SELECT name, qualified, s.kind, signature, visibility, doc, path, line_start, line_end, s.blob_sha, s.parser_id,
  CASE WHEN b.analyzer_id IS NOT NULL THEN {LANGUAGE.format("b.parser_id")} END AS language
FROM symbols s JOIN e ON e.blob_sha = s.blob_sha JOIN blobs b ON b.blob_sha = s.blob_sha WHERE s.scope = 'top_level' AND {{where}}
ORDER BY language NULLS LAST, path, line_start, qualified, s.parser_id LIMIT {{limit}}"""


def symbols_sql(where: str, limit: int = 50) -> str:
    return f"WITH {FILES} {SYMBOLS_SELECT.format(where=where, limit=limit)}"


def spaced(column: str) -> str:
    return f"(' ' || array_to_string(regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ')"


def any_column(pattern: str) -> str:
    return "(" + " OR ".join(f"contains({spaced(c)}, '{pattern}')" for c in ("name", "qualified", "doc")) + ")"


S = ("symbols", "blobs", "manifest_entries")
query("q1_find_symbols_exact", symbols_sql("(name = 'red_widget' OR qualified = 'red_widget')"), *S)(lambda f: lookup.find_symbols(f, HEAD, "red_widget"))
query("q1_find_symbols_kind", symbols_sql("s.kind = 'class'", 500), *S)(lambda f: lookup.find_symbols(f, HEAD, kind="class", limit=500))
query("q1_find_symbols_container", symbols_sql(f"({FOLD.format('qualified')} LIKE 'brand1::%' OR {FOLD.format('qualified')} LIKE 'brand1.%')"), *S)(lambda f: lookup.find_symbols(f, HEAD, container="Brand1"))
query("q1_find_symbols_path", symbols_sql(f"{FOLD.format('path')} LIKE 'shared/s_.py%'", 400), *S)(lambda f: lookup.find_symbols(f, HEAD, path="shared/S_.py", limit=400))
query("f14_find_symbols_words", symbols_sql(f"{any_column(' ring ')} AND {any_column(' small ')}", 1000), *S)(lambda f: lookup.find_symbols(f, HEAD, "Small ring", fuzzy=True, limit=1000))
query("f14_find_symbols_phrase", symbols_sql(any_column(" part small "), 1000), *S)(lambda f: lookup.find_symbols(f, HEAD, '"part: small"', fuzzy=True, limit=1000))
query("f14_find_symbols_prefix", symbols_sql(f"{any_column(' wid')} AND {any_column(' red ')}", 1000), *S)(lambda f: lookup.find_symbols(f, HEAD, "wid* red", fuzzy=True, limit=1000))

# ---- implementations and imports

IMPLEMENTATIONS = """SELECT type_qualified, interface_qualified, coalesce(r.semantic_kind, i.kind) AS kind, coalesce(r.source, 'tier2-fact') AS kind_source,
  path, line, i.blob_sha, i.parser_id, r.target_path
FROM implementations i JOIN e ON e.blob_sha = i.blob_sha
LEFT JOIN best r ON r.site_blob_sha = i.blob_sha AND r.site_parser_id = i.parser_id AND r.site_byte_start = i.interface_byte_start AND r.site_byte_end = i.interface_byte_end
WHERE {where} ORDER BY path, line, i.id LIMIT {limit}"""
I = ("implementations", "resolutions", "manifest_entries")
query("q2_find_subtypes", f"WITH {best_of('type')}, {FILES} {IMPLEMENTATIONS.format(where="interface_qualified = 'IMACHINERY'", limit=1000)}", *I)(lambda f: lookup.find_subtypes(f, HEAD, "IMACHINERY", 1000))
query("q3_find_supertypes", f"WITH {best_of('type')}, {FILES} {IMPLEMENTATIONS.format(where="type_qualified = 'T7'", limit=100)}", *I)(lambda f: lookup.find_supertypes(f, HEAD, "T7"))
IMPORTS = """SELECT path, to_module, imported, alias, is_reexport, line, r.target_path, coalesce(r.source, 'tier2-fact') AS kind_source, i.blob_sha, i.parser_id
FROM imports i JOIN e ON e.blob_sha = i.blob_sha
LEFT JOIN best r ON r.site_blob_sha = i.blob_sha AND r.site_parser_id = i.parser_id AND r.site_byte_start = i.byte_start AND r.site_byte_end = i.byte_end
{where} ORDER BY path, line, i.id LIMIT {limit}"""
M = ("imports", "resolutions", "manifest_entries")
query("q5_find_imports", f"WITH {best_of('import')}, {FILES} {IMPORTS.format(where='', limit=200)}", *M)(lambda f: lookup.find_imports(f, HEAD))
query("q5_find_imports_file", f"WITH {best_of('import')}, {FILES} {IMPORTS.format(where="WHERE path = 'Shared/s7.py'", limit=100000)}", *M)(lambda f: lookup.find_imports(f, HEAD, "Shared/s7.py", 100000))

# ---- references

R = ("refs", "symbols", "resolutions", "manifest_entries")


def references_sql(source: str, where: str, outgoing: bool = False, noise: bool = False, last: str = "", limit: int = 100, calls: bool = True) -> str:
    """calls: whether outgoing references without noise are calls only, as they are unless a kind is asked for."""
    noise_where = "" if noise else "WHERE dup = 1 AND NOT (source_rank > 0 AND byte_start = 0 AND byte_end = 0 AND shadowed)"
    final = (noise_where + (f" AND {last}" if noise_where else f"WHERE {last}")) if last else noise_where
    only = "AND r.kind = 'call' " if calls else ""
    own = f"{only}AND ((r.target_qualified IS NOT NULL AND r.target_qualified <> '') OR sym.qualified IS NOT NULL)" if outgoing and not noise else ""
    return f"""
SELECT target_name, target_qualified, kind, enclosing, path, line, blob_sha, parser_id, kind_source, target_path FROM (
  SELECT r.target_name, coalesce(sym.qualified, r.target_qualified) AS target_qualified, r.kind, enc.qualified AS enclosing, e.path, r.line, r.blob_sha, r.parser_id,
         r.byte_start, r.byte_end, r.id, res.target_path, coalesce(res.source, 'tier2-fact') AS kind_source, {RANK.format("r.source")} AS source_rank,
         EXISTS (SELECT 1 FROM refs t WHERE t.blob_sha = r.blob_sha AND (starts_with(t.source, 'tier3-') OR starts_with(t.source, 'tier25-')) AND t.line = r.line
                 AND t.kind = r.kind AND t.target_name = r.target_name AND t.enclosing_id IS NOT DISTINCT FROM r.enclosing_id) AS shadowed,
         row_number() OVER (PARTITION BY r.blob_sha, r.byte_start, r.byte_end, r.kind
                            ORDER BY {RANK.format("r.source")}, CASE WHEN r.target_qualified IS NOT NULL AND r.target_qualified <> '' THEN 0 ELSE 1 END, r.source, e.path, r.id) AS dup
  FROM {source} r JOIN e ON e.blob_sha = r.blob_sha
  LEFT JOIN best res ON res.site_blob_sha = r.blob_sha AND res.site_parser_id = r.parser_id AND res.site_byte_start = r.byte_start AND res.site_byte_end = r.byte_end AND res.kind = r.kind
  LEFT JOIN symbols sym ON sym.id = res.target_symbol_id
  {"" if outgoing else "LEFT "}JOIN symbols enc ON enc.id = r.enclosing_id
  WHERE {where} {own}) {final}
ORDER BY path, line, byte_start, source_rank, id LIMIT {limit}"""


HEADER = f"WITH {BY_KIND}, {FILES}"
STRICT = "Brand2::blue_gear"
STRICT_REFS = f"""{HEADER}, strict AS (
  SELECT r.* FROM refs r WHERE r.target_qualified = '{STRICT}'
  UNION ALL
  SELECT r.* FROM refs r JOIN best res ON res.site_blob_sha = r.blob_sha AND res.site_parser_id = r.parser_id AND res.site_byte_start = r.byte_start
         AND res.site_byte_end = r.byte_end AND res.kind = r.kind JOIN symbols sym ON sym.id = res.target_symbol_id
  WHERE sym.qualified = '{STRICT}' AND (r.target_qualified IS NULL OR r.target_qualified <> '{STRICT}'))"""
query("q6_references_bare", HEADER + references_sql("refs", "r.target_name = 'red_widget'"), *R)(lambda f: lookup.references_by_name(f, HEAD, "red_widget"))
query("q6_references_bare_noise", HEADER + references_sql("refs", "r.target_name = 'red_widget'", noise=True, limit=3000), *R)(lambda f: lookup.references_by_name(f, HEAD, "red_widget", include_noise=True, limit=3000))
query("q7_references_strict", STRICT_REFS + references_sql("strict", "true", last=f"target_qualified = '{STRICT}'", limit=1000), *R)(lambda f: lookup.references_strict(f, HEAD, STRICT, limit=1000))
query("q7_references_fallback", HEADER + references_sql("refs", "r.target_name = 'blue_bolt'"), *R)(lambda f: lookup.find_references(f, HEAD, "nowhere::blue_bolt"))
query("q8_references_outgoing", HEADER + references_sql("refs", f"enc.qualified = '{STRICT}'", outgoing=True, limit=1000), *R)(lambda f: lookup.references_outgoing(f, HEAD, STRICT, limit=1000))
query("q8_references_outgoing_noise", HEADER + references_sql("refs", f"enc.qualified = '{STRICT}'", outgoing=True, noise=True, limit=1000), *R)(lambda f: lookup.references_outgoing(f, HEAD, STRICT, include_noise=True, limit=1000))
query("q8_references_outgoing_type", HEADER + references_sql("refs", f"enc.qualified = '{STRICT}' AND r.kind = 'type'", outgoing=True, calls=False), *R)(lambda f: lookup.references_outgoing(f, HEAD, STRICT, kind="type"))
query("q8_references_outgoing_type_noise", HEADER + references_sql("refs", f"enc.qualified = '{STRICT}' AND r.kind = 'type'", outgoing=True, noise=True), *R)(lambda f: lookup.references_outgoing(f, HEAD, STRICT, kind="type", include_noise=True))
query("q12_find_callers", HEADER + references_sql("refs", "r.target_name = 'small_ring' AND r.kind = 'call'"), *R)(lambda f: lookup.find_callers(f, HEAD, "small_ring"))
query("q13_find_callees", HEADER + references_sql("refs", "enc.qualified = 'Brand25::cold_bolt' AND r.kind = 'call'", outgoing=True), *R)(lambda f: lookup.find_callees(f, HEAD, "Brand25::cold_bolt"))

MANY = HEADER + references_sql("refs", "true", limit=1).replace("r.target_name, coalesce", "r.target_name AS wanted, r.target_name, coalesce", 1).replace("PARTITION BY r.blob_sha", "PARTITION BY r.target_name, r.blob_sha")
MANY = MANY.replace("SELECT target_name, target_qualified", "SELECT wanted, target_name, target_qualified", 1).replace(
    "\nORDER BY path, line, byte_start, source_rank, id LIMIT 1", " QUALIFY rank <= 100"
).replace("target_path FROM (", "target_path, row_number() OVER (PARTITION BY wanted ORDER BY path, line, byte_start, source_rank, id)::INTEGER AS rank FROM (", 1)
query("q6_references_many", MANY, *R)(lambda f: lookup.find_references_many(f, HEAD, f.symbols.select("name")))

# ---- outlines and sources

query(
    "q14_outline_file",
    f"WITH {FILES} SELECT name, qualified, kind, signature, path, line_start, line_end, scope, parent_id, id FROM symbols JOIN e USING (blob_sha) WHERE path = 'Shared/s5.py' ORDER BY line_start, id",
    *S,
)(lambda f: lookup.get_outline(f, HEAD, "Shared/s5.py"))
query(
    "q15_outline_path",
    f"WITH {FILES} SELECT name, qualified, kind, path, line_start, line_end, id FROM symbols JOIN e USING (blob_sha) WHERE starts_with(path, 'src/') AND kind = 'method' "
    "AND length(substr(path, 5)) - length(replace(substr(path, 5), '/', '')) <= 1 ORDER BY path, line_start, id LIMIT 1000",
    *S,
)(lambda f: lookup.get_outline_under_path(f, HEAD, "src/", kind="method", max_depth=2, limit=1000))
SOURCES = """SELECT id AS symbol_id, qualified, kind, signature, path, blob_sha, parser_id, line_start, line_end, byte_start, byte_end FROM (
  SELECT s.*, path, row_number() OVER (PARTITION BY path, s.blob_sha, byte_start, byte_end ORDER BY parser_id, id) AS k FROM symbols s JOIN e ON e.blob_sha = s.blob_sha WHERE {where}) WHERE k = 1
ORDER BY path, line_start, byte_start, byte_end, blob_sha LIMIT 21"""
query("q16_symbol_source_rows", f"WITH {FILES} {SOURCES.format(where=f"qualified = '{STRICT}'")}", *S)(lambda f: lookup.symbol_source_rows(f, HEAD, STRICT))
CONTENTS = """contents AS (SELECT 'b' || CAST(doc_id % (SELECT count(*) FROM supplier) AS VARCHAR) AS blob_sha, string_agg(text, chr(10) ORDER BY doc_id, text) AS content FROM documents WHERE text IS NOT NULL GROUP BY 1)"""


def contents(f: Facts) -> DataFrame:
    """A content per blob: the texts of all documents whose id falls to it, one after the other."""
    n = f.supplier.count()
    texts = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    return f.documents.filter("text IS NOT NULL").groupBy(F.concat(F.lit("b"), (F.col("doc_id") % n).cast("string")).alias("blob_sha")).agg(F.array_join(texts, "\n").alias("content"))


query(
    "q17_symbol_bodies",
    f"WITH {CONTENTS} SELECT s.id, s.qualified, hex(array_slice(encode(content), byte_start + 1, byte_end)) AS body FROM symbols s JOIN contents c ON c.blob_sha = s.blob_sha",
    "symbols",
)(lambda f: f.symbols.join(contents(f), "blob_sha").select("id", "qualified", F.hex(lookup.bytes_of(F.encode("content", "UTF-8"), F.col("byte_start"), F.col("byte_end"))).alias("body")))
# the same as text; without a twin, whose decode() fails at cut characters
query("q17_symbol_texts", None)(
    lambda f: f.symbols.join(contents(f), "blob_sha").select("id", "qualified", lookup.body_of(F.encode("content", "UTF-8"), F.col("byte_start"), F.col("byte_end")).alias("body"))
)
query(
    "q18_dedup_sources",
    """SELECT alias, symbol_id, path FROM (
  SELECT alias, s.id AS symbol_id, e.path, row_number() OVER (PARTITION BY repo_hash, e.path, s.blob_sha, byte_start, byte_end ORDER BY alias, s.parser_id, s.id) AS k
  FROM aliases JOIN repositories USING (repo_hash) JOIN manifest_entries e USING (manifest_id) JOIN symbols s ON s.blob_sha = e.blob_sha WHERE s.kind = 'test') WHERE k = 1""",
    "symbols", "manifest_entries", "aliases", "repositories",
)(
    lambda f: lookup.dedup_sources(
        f.aliases.select("alias", "repo_hash").join(f.repositories.select("repo_hash", "manifest_id"), "repo_hash").join(f.manifest_entries, "manifest_id").join(f.symbols.filter("kind = 'test'").withColumnRenamed("id", "symbol_id"), "blob_sha")
    ).select("alias", "symbol_id", "path")
)
query(
    "q23_snippets",
    f"WITH {CONTENTS} SELECT r.id, r.line, regexp_replace(list_extract(string_split(content, chr(10)), r.line), '\\r+$', '') AS snippet FROM refs r LEFT JOIN contents c ON c.blob_sha = r.blob_sha",
    "refs",
)(lambda f: lookup.with_snippets(f.derived("refs").select("id", "blob_sha", "line"), contents(f)).select("id", "line", "snippet"))
query(
    "q24_locations",
    f"WITH {FILES} SELECT s.id, 'demo:HEAD:' || path || ':' || CAST(line_start AS VARCHAR) AS location FROM symbols s JOIN e USING (blob_sha)",
    *S,
)(lambda f: f.symbols.join(snapshots.entries_of(f.manifest_entries, HEAD), "blob_sha").select("id", text.location(F.lit("demo"), F.lit("HEAD"), F.col("path"), F.col("line_start")).alias("location")))


EVERY = f"""WITH own AS (SELECT alias, manifest_id FROM aliases JOIN repositories USING (repo_hash)), e AS (SELECT alias, path, blob_sha FROM manifest_entries JOIN own USING (manifest_id)),
f AS (SELECT alias, name, qualified, s.kind, path, line_start, s.blob_sha, s.parser_id, CASE WHEN b.analyzer_id IS NOT NULL THEN {LANGUAGE.format("b.parser_id")} END AS language
  FROM symbols s JOIN e ON e.blob_sha = s.blob_sha JOIN blobs b ON b.blob_sha = s.blob_sha WHERE s.scope = 'top_level' AND {{where}}),
k AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY language NULLS LAST, path, line_start, qualified, parser_id) AS k FROM f)
SELECT alias, path, line_start, qualified, parser_id, language FROM k WHERE k <= {{limit}} ORDER BY language NULLS LAST, path, line_start, alias, qualified, parser_id, name, blob_sha LIMIT {{limit}}"""


def _over(f: Facts, **filters) -> DataFrame:
    """A lookup in the current snapshot of every repository."""
    targets = f.aliases.select("alias", "repo_hash").join(f.repositories.select("repo_hash", "manifest_id"), "repo_hash")
    return lookup.find_symbols_over(f, targets, **filters).select("alias", "path", "line_start", "qualified", "parser_id", "language")


query("q25_over_repos", EVERY.format(where="s.kind = 'class'", limit=50), *S, "aliases", "repositories")(lambda f: _over(f, kind="class"))
query("q25_over_repos_name", EVERY.format(where="(name = 'red_widget' OR qualified = 'red_widget')", limit=300), *S, "aliases", "repositories")(lambda f: _over(f, query="red_widget", limit=300))

# ---- names

NORMAL = f"regexp_replace(trim(regexp_replace({{0}}, '{SPACE.replace('{', '{{').replace('}', '}}')}', ' ', 'g')), '^(::)+', '')"
#: Names with odd white space and leading separators.
ODD_NAME = "CASE id % 4 WHEN 0 THEN '::' || qualified WHEN 1 THEN '  ::::' || replace(qualified, '_', '\u3000\t') WHEN 2 THEN qualified || '\u00a0' ELSE qualified END"
query(
    "f8_normalized_names",
    f"SELECT id, qualified, {NORMAL.format(ODD_NAME)} AS normal, (contains(qualified, '::') OR contains(qualified, '.') OR contains(qualified, chr(92))) AS is_qualified, regexp_extract(qualified, '([^.:\\\\]*)$', 1) AS bare FROM symbols",
    "symbols",
)(lambda f: f.symbols.select("id", "qualified", text.normalize_qualified(F.expr(ODD_NAME)).alias("normal"), text.is_qualified_column(F.col("qualified")).alias("is_qualified"), text.bare_name_column(F.col("qualified")).alias("bare")))
query(
    "f1_git_sha",
    "SELECT doc_id, sha1(encode('blob ' || CAST(strlen(text) AS VARCHAR)) || '\\x00'::BLOB || encode(text)) AS sha FROM documents",
)(lambda f: f.documents.select("doc_id", text.git_sha(F.encode("text", "UTF-8")).alias("sha")))
query("f3_languages", f"SELECT blob_sha, parser_id, {LANGUAGE.format('parser_id')} AS language FROM blobs", "blobs")(lambda f: f.blobs.select("blob_sha", "parser_id", text.language_of(F.col("parser_id")).alias("language")))
#: Texts with white space of all kinds.
ODD_TEXT = "'\u2003' || replace(replace(text, ' the ', '\u00a0 the\u2028'), '.', '.\u3000\u0085')"
query("f5_collapsed_space", f"SELECT doc_id, trim(regexp_replace({ODD_TEXT}, '{SPACE}', ' ', 'g')) AS text FROM documents")(lambda f: f.documents.select("doc_id", text.collapse_space(F.expr(ODD_TEXT)).alias("text")))
#: Paths of packages, stubs and other files.
ODD_PATH = "CASE length(path) % 4 WHEN 0 THEN replace(path, '.py', '/__init__.py') WHEN 1 THEN path || 'i' WHEN 2 THEN CASE WHEN starts_with(path, 'Shared/') THEN '__init__.py' ELSE 'README.md' END ELSE path END"
query(
    "f10_modules",
    f"SELECT path, file, CASE WHEN NOT suffix(file, '.py') OR file = '__init__.py' THEN NULL WHEN suffix(file, '/__init__.py') THEN replace(left(file, length(file) - 12), '/', '.') ELSE replace(left(file, length(file) - 3), '/', '.') END AS module FROM (SELECT path, {ODD_PATH} AS file FROM manifest_entries)",
    "manifest_entries",
)(lambda f: f.manifest_entries.select("path", F.expr(ODD_PATH.replace("starts_with", "startswith")).alias("file")).withColumn("module", text.module_of(F.col("file"))))
query(
    "f13_timestamps",
    "SELECT job_id, strftime(make_timestamp(started_at_ns // 1000), '%Y-%m-%dT%H:%M:%SZ') AS started FROM runs WHERE job_id IS NOT NULL",
    "runs",
)(lambda f: f.runs.filter("job_id IS NOT NULL").select("job_id", text.rfc3339(F.col("started_at_ns")).alias("started")))
query(
    "f15_backoff",
    "SELECT repo_hash, least(5000000000 * pow(2.0, least(greatest(consecutive_failures - 1, 0), 20))::BIGINT, 600000000000)::BIGINT AS delay_ns FROM reconcile_state",
    "reconcile_state",
)(lambda f: f.reconcile_state.select("repo_hash", text.backoff_ns(F.col("consecutive_failures")).alias("delay_ns")))
ANCHOR_RANK = "CASE WHEN anchor_name = 'HEAD' THEN 0 WHEN starts_with(anchor_name, 'branch/') THEN 1 WHEN starts_with(anchor_name, 'tag/') THEN 2 WHEN starts_with(anchor_name, 'tentative/') THEN 3 ELSE 4 END"
query(
    "f20_anchor_order",
    f"SELECT anchor_name, {ANCHOR_RANK} AS rank, CASE {ANCHOR_RANK} WHEN 0 THEN 'head' WHEN 1 THEN 'branch' WHEN 2 THEN 'tag' WHEN 3 THEN 'tentative' END AS kind FROM anchors",
    "anchors",
)(lambda f: f.anchors.select("anchor_name", text.anchor_rank(F.col("anchor_name")).alias("rank"), text.anchor_kind(F.col("anchor_name")).alias("kind")))
query("s11_anchor_prefix", "SELECT anchor_name, manifest_id FROM anchors WHERE starts_with(anchor_name, 'tentative/')", "anchors")(lambda f: snapshots.anchors_with_prefix(f.anchors, "tentative/").select("anchor_name", "manifest_id"))
query(
    "s10_entry_upsert",
    "WITH changed AS (SELECT manifest_id, path, CASE WHEN length(path) % 2 = 0 THEN 'new' END AS blob_sha FROM manifest_entries WHERE starts_with(path, 'src/')) "
    "SELECT manifest_id, path, blob_sha FROM manifest_entries WHERE NOT starts_with(path, 'src/') UNION ALL SELECT * FROM changed WHERE blob_sha IS NOT NULL",
    "manifest_entries",
)(
    lambda f: snapshots.upsert_entries(
        f.manifest_entries, f.manifest_entries.filter(F.col("path").startswith("src/")).select("manifest_id", "path", F.when(F.length("path") % 2 == 0, "new").alias("blob_sha"))
    )
)

# ---- repositories, jobs and status

query("a1_counts", "SELECT m.manifest_id, m.files, s.symbols FROM (SELECT manifest_id, count(*) AS files FROM manifest_entries GROUP BY 1) m JOIN (SELECT manifest_id, count(*) AS symbols FROM manifest_entries JOIN symbols USING (blob_sha) GROUP BY 1) s USING (manifest_id)", "manifest_entries", "symbols")(
    lambda f: repos.count_files(f.manifest_entries).join(repos.count_symbols(f.manifest_entries, f.symbols), "manifest_id")
)
query("a2_jobs_by_status", "SELECT status, count(*) AS jobs FROM runs WHERE job_id IS NOT NULL AND manifest_id IN (SELECT manifest_id FROM anchors) GROUP BY 1", "runs", "anchors")(lambda f: repos.jobs_by_status(f.runs, f.anchors))
ACTIVE = "SELECT a.manifest_id, count(r.job_id) AS active FROM (SELECT DISTINCT manifest_id FROM anchors) a LEFT JOIN (SELECT * FROM runs WHERE job_id IS NOT NULL AND status IN ('queued', 'running')) r ON r.manifest_id = a.manifest_id GROUP BY 1"
query("a3_active_jobs", ACTIVE, "runs", "anchors")(lambda f: repos.active_jobs(f.runs, f.anchors))
query("a4_parsers", "SELECT DISTINCT manifest_id, parser_id FROM manifest_entries JOIN blobs USING (blob_sha)", "manifest_entries", "blobs")(lambda f: repos.parsers_of(f.manifest_entries, f.blobs))
ENRICH = f"""SELECT manifest_id, {LANGUAGE.format("parser_id")} AS language,
  CASE WHEN bool_or(analyzer_id IS NOT NULL AND EXISTS (SELECT 1 FROM analyzers a WHERE a.parser_id = x.parser_id AND a.analyzer_id = x.analyzer_id)) THEN 'semantic' ELSE 'syntactic' END AS tier,
  bool_or(parser_id IN (SELECT parser_id FROM analyzers)) AS has_analyzer
FROM (SELECT manifest_id, parser_id, analyzer_id FROM manifest_entries JOIN blobs USING (blob_sha)) x GROUP BY 1, 2"""
query("a5_enrichment", ENRICH, "manifest_entries", "blobs", "analyzers")(lambda f: repos.enrichment(f.manifest_entries, f.blobs, f.analyzers))
query(
    "a6_snapshots",
    f"SELECT manifest_id, string_agg(anchor_name, ',' ORDER BY {ANCHOR_RANK}, CASE WHEN anchor_name = 'HEAD' THEN '' WHEN starts_with(anchor_name, 'branch/') THEN substr(anchor_name, 8) ELSE anchor_name END) AS labels, max(last_updated_ns) AS last_updated_ns FROM anchors GROUP BY 1",
    "anchors",
)(lambda f: repos.snapshots(f.anchors).withColumn("labels", F.array_join("labels", ",")))
SHOTS = f"""shots AS (SELECT DISTINCT repo_hash, manifest_id FROM repo_anchors),
enr AS ({ENRICH}),
st AS (SELECT s.repo_hash, s.manifest_id, coalesce(files, 0) AS files, coalesce(symbols, 0) AS symbols,
         CASE WHEN files IS NULL THEN 'empty' WHEN symbols > 0 THEN 'ready' WHEN coalesce(has, false) THEN 'stale' ELSE 'no_analyzer' END AS status
  FROM shots s LEFT JOIN (SELECT manifest_id, count(*) AS files FROM manifest_entries GROUP BY 1) fi USING (manifest_id)
  LEFT JOIN (SELECT manifest_id, count(*) AS symbols FROM manifest_entries JOIN symbols USING (blob_sha) GROUP BY 1) sy USING (manifest_id)
  LEFT JOIN (SELECT manifest_id, bool_or(has_analyzer) AS has FROM enr GROUP BY 1) en USING (manifest_id))"""
LIST = f"""WITH {SHOTS},
jobs AS (SELECT repo_hash, count(*) AS active FROM shots JOIN runs USING (manifest_id) WHERE job_id IS NOT NULL AND runs.status IN ('queued', 'running') GROUP BY 1),
lang AS (SELECT repo_hash, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM shots JOIN enr USING (manifest_id) GROUP BY 1),
agg AS (SELECT repo_hash, count(*) AS n, bool_or(status = 'missing') AS bad, bool_or(status = 'reconciling') AS moving, bool_or(status IN ('stale', 'no_analyzer')) AS part FROM st GROUP BY 1)
SELECT a.alias, r.root_path, coalesce(languages, '') AS languages, coalesce(agg.n, 0) AS snapshot_count, coalesce(cur.files, 0) AS current_file_count, coalesce(cur.symbols, 0) AS current_symbol_count,
  CASE WHEN agg.n IS NULL OR bad THEN 'error' WHEN active > 0 OR moving THEN 'indexing' WHEN part THEN 'partial' ELSE 'ready' END AS status
FROM aliases a JOIN repositories r USING (repo_hash) LEFT JOIN agg USING (repo_hash) LEFT JOIN lang USING (repo_hash) LEFT JOIN jobs USING (repo_hash)
LEFT JOIN st cur ON cur.repo_hash = r.repo_hash AND cur.manifest_id = r.manifest_id"""
L = ("manifest_entries", "blobs", "analyzers", "symbols", "runs", "aliases", "repositories", "repo_anchors")
query("q19_list_repos", LIST, *L)(lambda f: repos.list_repos(f.aliases, f.repositories, f))
query("q19_list_repos_search", f"{LIST} WHERE contains(a.alias, '1') OR contains(r.root_path, '1') ORDER BY alias LIMIT 8", *L)(lambda f: repos.list_repos(f.aliases, f.repositories, f, "1", 8))
query("q20_repo_status", f"{LIST} WHERE r.repo_hash = 'h7'", *L)(lambda f: repos.repo_status(f.aliases, f.repositories, f, path="/work/r2/nested/nation_7/src/x.py"))
query(
    "q20_repo_snapshots",
    f"""WITH {SHOTS}, l AS (SELECT repo_hash, manifest_id, {ANCHOR_RANK} AS r, CASE WHEN anchor_name = 'HEAD' THEN '' WHEN starts_with(anchor_name, 'branch/') THEN substr(anchor_name, 8) ELSE anchor_name END AS k,
  CASE WHEN starts_with(anchor_name, 'branch/') THEN substr(anchor_name, 8) ELSE anchor_name END AS name FROM repo_anchors),
g AS (SELECT repo_hash, manifest_id, string_agg(name, ',' ORDER BY r, k, name) AS labels, min(struct_pack(r := r, k := k)) AS first FROM l GROUP BY 1, 2),
n AS (SELECT manifest_id, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM enr GROUP BY 1)
SELECT st.repo_hash, row_number() OVER (PARTITION BY st.repo_hash ORDER BY first.r, first.k, st.manifest_id)::INTEGER AS position, st.manifest_id, labels, status, files, symbols, coalesce(languages, '') AS languages
FROM st JOIN g ON g.repo_hash = st.repo_hash AND g.manifest_id = st.manifest_id LEFT JOIN n ON n.manifest_id = st.manifest_id""",
    *L,
)(lambda f: repos.repo_snapshots(f).withColumns({c: F.array_join(c, ",") for c in ("labels", "languages")}))
PATHS = "p AS (SELECT DISTINCT '/work/r' || CAST(n_regionkey AS VARCHAR) || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '/nested' END || '/' || lower(n_name) || CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE '' END || '/s' || CAST(s_suppkey AS VARCHAR) AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _paths(f: Facts) -> DataFrame:
    root = F.concat(F.lit("/work/r"), F.col("n_regionkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("/nested"), F.lit("/"), F.lower("n_name"))
    path = F.concat(root, F.when(F.col("s_suppkey") % 3 == 0, "x").otherwise(""), F.lit("/s"), F.col("s_suppkey").cast("string"))
    return f.supplier.join(f.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(path.alias("path")).distinct()


query(
    "q21_repo_by_path",
    f"WITH {PATHS} SELECT path, r.repo_hash, r.root_path FROM p LEFT JOIN repositories r ON starts_with(path, r.root_path || '/') OR path = r.root_path QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(r.root_path) DESC) = 1",
    "repositories",
)(lambda f: repos.resolve_repo_by_path(_paths(f), f.repositories))
JOBS = "SELECT job_id, manifest_id, analyzer_id, status, started_at_ns, finished_at_ns, floor((finished_at_ns - started_at_ns) / 1000000)::BIGINT AS run_ms, error, cancel_requested FROM runs WHERE job_id IS NOT NULL AND {0} AND manifest_id IN (SELECT manifest_id FROM anchors) ORDER BY job_id DESC, manifest_id, analyzer_id"
query("q22_list_jobs", JOBS.format("status IN ('queued', 'running')"), "runs", "anchors")(lambda f: repos.list_jobs(f.runs, f.anchors))
query("q22_list_jobs_failed", JOBS.format("status = 'failed'") + " LIMIT 100", "runs", "anchors")(lambda f: repos.list_jobs(f.runs, f.anchors, "failed", limit=100))
query("q22_list_jobs_all", JOBS.format("true"), "runs", "anchors")(lambda f: repos.list_jobs(f.runs, f.anchors, include_terminal=True))


def _analyzers(f: Facts) -> DataFrame:
    ids = F.concat(F.lit("analyzer-"), F.col("o_orderkey").cast("string"))
    parser = F.element_at(F.array(*[F.lit(x) for x in ("tree-sitter-python", "tree-sitter-rust@2", "tree-sitter-java", "nowhere")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return f.orders.select(ids.alias("analyzer_id"), parser.alias("parser_id"), F.lit(2).alias("revision"))


query(
    "q28_tier_status",
    f"""WITH an AS (SELECT 'analyzer-' || CAST(o_orderkey AS VARCHAR) AS analyzer_id, CASE o_orderkey % 4 WHEN 0 THEN 'tree-sitter-python' WHEN 1 THEN 'tree-sitter-rust@2' WHEN 2 THEN 'tree-sitter-java' ELSE 'nowhere' END AS parser_id FROM orders),
ps AS (SELECT DISTINCT parser_id FROM manifest_entries JOIN blobs USING (blob_sha) WHERE manifest_id = {HEAD}),
rs AS (SELECT analyzer_id, status, error, analyzer_revision FROM runs WHERE manifest_id = {HEAD})
SELECT an.analyzer_id, an.parser_id,
  CASE WHEN status IS NULL THEN 'missing' WHEN analyzer_revision <> 2 THEN 'stale' WHEN status = 'succeeded' THEN 'ready' WHEN status IN ('queued', 'running', 'skipped') THEN status ELSE 'failed' END AS state,
  CASE WHEN status IS NULL THEN 'not_scheduled' WHEN analyzer_revision <> 2 THEN 'stale' WHEN status IN ('succeeded', 'queued', 'running') THEN NULL WHEN status = 'timed_out' THEN 'timed_out' WHEN status = 'failed' THEN 'analyzer_failed' ELSE 'unknown' END AS reason_code
FROM an LEFT JOIN rs USING (analyzer_id) WHERE an.parser_id IN (SELECT parser_id FROM ps)
UNION ALL SELECT NULL, parser_id, 'not_applicable', 'not_applicable' FROM ps WHERE parser_id NOT IN (SELECT parser_id FROM an)""",
    "manifest_entries", "blobs", "runs",
)(lambda f: repos.tier_status(_analyzers(f), repos.parsers_of(f.manifest_entries, f.blobs), f.runs, HEAD))
query("a9_first_registration", "SELECT repo_hash, min(registered_at_ns) AS registered_at_ns FROM aliases GROUP BY 1", "aliases")(lambda f: repos.with_first_registration(f.aliases))

# ---- interval joins and resolution

query(
    "j7_enclosing_by_bytes",
    """SELECT id, enclosing FROM (SELECT r.id, s.id AS enclosing, row_number() OVER (PARTITION BY r.id ORDER BY s.byte_end - s.byte_start, s.id) AS k FROM refs r
  LEFT JOIN symbols s ON s.blob_sha = r.blob_sha AND s.parser_id = r.parser_id AND s.kind IN ('function', 'method', 'test') AND s.byte_start <= r.byte_start AND s.byte_end >= r.byte_end) WHERE k = 1""",
    "refs", "symbols",
)(lambda f: enclosing.enclosing_by_bytes(f.refs.select("id", "blob_sha", "parser_id", "byte_start", "byte_end"), f.symbols).select("id", "enclosing"))
query(
    "j8_enclosing_by_line",
    """SELECT id, enclosing FROM (SELECT r.id, s.id AS enclosing, row_number() OVER (PARTITION BY r.id ORDER BY s.line_end - s.line_start, s.line_start DESC, s.id) AS k FROM refs r
  LEFT JOIN symbols s ON s.blob_sha = r.blob_sha AND s.line_start <= r.line AND s.line_end >= r.line) WHERE k = 1""",
    "refs", "symbols",
)(lambda f: enclosing.enclosing_by_line(f.refs.select("id", "blob_sha", "line"), f.symbols).select("id", "enclosing"))
query("j10_symbol_paths", f"SELECT s.id, min(path) AS path FROM symbols s JOIN manifest_entries e ON e.blob_sha = s.blob_sha WHERE manifest_id = {HEAD} GROUP BY 1", "symbols", "manifest_entries")(lambda f: enclosing.path_of_symbol(f.symbols, f.manifest_entries, HEAD))


def _targets(f: Facts) -> DataFrame:
    """Targets as an analyzer gives them: paths that exist, that do not, or none."""
    path = F.when(F.col("id") % 4 == 0, F.concat(F.lit("Shared/s"), (F.col("id") % 90).cast("string"), F.lit(".py"))).when(F.col("id") % 4 == 1, F.lit("gone.py"))
    return f.refs.select("id", "kind", path.alias("target_path"), F.when(F.col("target_qualified") != "", F.col("target_qualified")).alias("target_qualified"))


query(
    "j9_resolve_targets",
    f"""WITH {FILES}, t AS (SELECT id, kind, CASE id % 4 WHEN 0 THEN 'Shared/s' || CAST(id % 90 AS VARCHAR) || '.py' WHEN 1 THEN 'gone.py' END AS target_path, CASE WHEN target_qualified <> '' THEN target_qualified END AS target_qualified FROM refs),
b AS (SELECT t.*, e.blob_sha AS blob FROM t LEFT JOIN e ON e.path = t.target_path),
own AS (SELECT blob_sha, qualified, id FROM symbols WHERE parser_id = 'tree-sitter-python' QUALIFY row_number() OVER (PARTITION BY blob_sha, qualified ORDER BY byte_end - byte_start, id) = 1),
inf AS (SELECT blob_sha, qualified, count(*) AS n, min(id) AS id FROM symbols GROUP BY 1, 2),
alls AS (SELECT qualified, count(*) AS n, min(id) AS id FROM symbols WHERE blob_sha IN (SELECT blob_sha FROM e) GROUP BY 1),
c AS (SELECT b.*, CASE WHEN target_path IS NOT NULL AND blob IS NOT NULL THEN coalesce(own.id, CASE WHEN inf.n = 1 THEN inf.id END)
                       WHEN target_path IS NULL AND kind <> 'import' AND alls.n = 1 THEN alls.id END AS sym
  FROM b LEFT JOIN own ON own.blob_sha = blob AND own.qualified = target_qualified LEFT JOIN inf ON inf.blob_sha = blob AND inf.qualified = target_qualified LEFT JOIN alls ON alls.qualified = target_qualified),
d AS (SELECT s.id, min(path) AS path FROM symbols s JOIN e ON e.blob_sha = s.blob_sha GROUP BY 1)
SELECT c.id, kind, target_path, target_qualified, CASE WHEN target_path IS NOT NULL AND blob IS NOT NULL THEN target_path WHEN target_path IS NULL THEN d.path END AS resolved_path,
  CASE WHEN target_path IS NOT NULL AND blob IS NOT NULL THEN sym WHEN target_path IS NULL AND d.path IS NOT NULL THEN sym END AS target_symbol_id
FROM c LEFT JOIN d ON d.id = c.sym""",
    *R,
)(lambda f: resolution.resolve_targets(_targets(f), f.symbols, f.manifest_entries, HEAD, "tree-sitter-python"))
DIRECT = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in resolution.DIRECT)
query(
    "i9_direct_resolutions",
    f"""SELECT id, blob_sha AS site_blob_sha, semantic_kind, 'tier2-direct-' || lang AS source FROM implementations
JOIN (VALUES {DIRECT}) d(lang, shape, semantic_kind) ON lang = {LANGUAGE.format("parser_id")} AND shape = syntactic_kind
WHERE interface_byte_start IS NOT NULL AND interface_byte_end IS NOT NULL""",
    "implementations",
)(lambda f: resolution.direct_resolutions(f.implementations, text.language_of(F.col("parser_id"))).select("id", "site_blob_sha", "semantic_kind", "source"))
query(
    "r11_replace_resolutions",
    f"""SELECT id, source, manifest_id FROM resolutions WHERE NOT (source = 'tier25-python' AND (manifest_id IS NOT DISTINCT FROM 1 OR (manifest_id IS NULL AND site_blob_sha IN (SELECT blob_sha FROM manifest_entries WHERE manifest_id = 1))))
UNION ALL SELECT -id, 'tier25-python', 1 FROM resolutions WHERE source = 'tier25-python' AND manifest_id = 1""",
    "resolutions", "manifest_entries",
)(
    lambda f: resolution.replace_resolutions(
        f.resolutions, f.manifest_entries, f.resolutions.filter("source = 'tier25-python' AND manifest_id = 1").withColumn("id", -F.col("id")), 1, "tier25-python"
    ).select("id", "source", "manifest_id")
)

# ---- maintenance

WANTED = "w AS (SELECT DISTINCT blob_sha, parser_id, 2 AS parser_revision, CAST(NULL AS VARCHAR) AS analyzer_id, CAST(NULL AS INT) AS analyzer_revision FROM manifest_entries JOIN (SELECT blob_sha, parser_id FROM blobs) USING (blob_sha) UNION ALL SELECT DISTINCT blob_sha, 'new-parser', 1, NULL, NULL FROM manifest_entries)"


def _wanted(f: Facts) -> DataFrame:
    none, rev = F.lit(None).cast("string").alias("analyzer_id"), F.lit(None).cast("int").alias("analyzer_revision")
    have = f.manifest_entries.select("blob_sha").join(f.blobs.select("blob_sha", "parser_id"), "blob_sha").select("blob_sha", "parser_id", F.lit(2).alias("parser_revision"), none, rev)
    return have.unionByName(f.manifest_entries.select("blob_sha", F.lit("new-parser").alias("parser_id"), F.lit(1).alias("parser_revision"), none, rev)).distinct()


B = ("manifest_entries", "blobs")
query(
    "i3_to_parse",
    f"WITH {WANTED} SELECT w.* FROM w LEFT JOIN blobs b USING (blob_sha, parser_id) WHERE b.blob_sha IS NULL OR b.parser_revision <> w.parser_revision OR b.analyzer_id IS DISTINCT FROM w.analyzer_id OR b.analyzer_revision IS DISTINCT FROM w.analyzer_revision".replace("SELECT w.*", "SELECT w.blob_sha, w.parser_id, w.parser_revision, w.analyzer_id, w.analyzer_revision"),
    *B,
)(lambda f: admin.to_parse(_wanted(f), f.blobs))
query(
    "a8_stale_revisions",
    f"WITH {WANTED} SELECT w.parser_id, b.parser_revision AS current_rev, max(w.parser_revision) AS expected_rev, count(*) AS affected FROM w LEFT JOIN blobs b USING (blob_sha, parser_id) WHERE b.parser_revision IS NULL OR b.parser_revision <> w.parser_revision GROUP BY 1, 2",
    *B,
)(lambda f: admin.stale_revisions(_wanted(f), f.blobs))
query(
    "m9_run_decisions",
    """SELECT manifest_id, analyzer_id, CASE WHEN analyzer_revision < 2 AND status IN ('queued', 'running') THEN 'active_stale' WHEN analyzer_revision < 2 THEN 'enqueue' WHEN analyzer_revision > 2 THEN 'skip'
  WHEN status IN ('failed', 'timed_out', 'cancelled') THEN 'terminal_failed_current' ELSE 'skip' END AS decision FROM runs""",
    "runs",
)(lambda f: f.runs.select("manifest_id", "analyzer_id", admin.classify_run(F.lit(2), F.col("analyzer_revision"), F.col("status")).alias("decision")))
query(
    "m11_reruns",
    "SELECT CAST(o_custkey % 5 AS BIGINT) AS manifest_id, 'analyzer-' || CAST(o_orderkey AS VARCHAR) AS analyzer_id, 2 AS revision FROM orders LEFT JOIN runs r ON r.manifest_id = o_custkey % 5 AND r.analyzer_id = 'analyzer-' || CAST(o_orderkey AS VARCHAR) WHERE r.status IS NULL OR r.status <> 'succeeded' OR r.analyzer_revision <> 2 OR r.config_hash <> 'cfg0'",
    "runs",
)(lambda f: admin.reruns(f.orders.select((F.col("o_custkey") % 5).alias("manifest_id"), F.concat(F.lit("analyzer-"), F.col("o_orderkey").cast("string")).alias("analyzer_id"), F.lit(2).alias("revision")), f.runs, "cfg0"))
query("m6_prune_blobs", "SELECT blob_sha, parser_id FROM blobs WHERE parser_id IN ('tree-sitter-python', 'markdown')", "blobs")(lambda f: admin.prune_blobs(f.blobs, ["tree-sitter-python", "markdown"]).select("blob_sha", "parser_id"))
query(
    "m7_prune_jobs",
    "SELECT manifest_id, analyzer_id, status FROM runs WHERE manifest_id IN (SELECT manifest_id FROM anchors) OR status IN ('queued', 'running')",
    "runs", "anchors",
)(lambda f: admin.prune_jobs(f.runs, f.anchors).select("manifest_id", "analyzer_id", "status"))
query("m7_cancel_job", "SELECT job_id, status, (coalesce(job_id = 8, false) AND status IN ('queued', 'running')) OR cancel_requested AS cancel_requested FROM runs WHERE job_id IS NOT NULL", "runs")(
    lambda f: admin.cancel_job(f.runs, 8).filter("job_id IS NOT NULL").select("job_id", "status", "cancel_requested")
)
query(
    "m8_prune_refs",
    "SELECT anchor_name, manifest_id FROM anchors WHERE NOT (starts_with(anchor_name, 'branch/') OR starts_with(anchor_name, 'tag/')) OR anchor_name IN (SELECT 'branch/' || r_name FROM region WHERE r_regionkey > 1)",
    "anchors",
)(lambda f: admin.prune_stale_refs(f.anchors, f.region.filter("r_regionkey > 1").select(F.concat(F.lit("branch/"), "r_name").alias("anchor_name"))).select("anchor_name", "manifest_id"))
query("s6_visible_symbols", "SELECT s.id, m.manifest_id FROM symbols s JOIN manifest_entries m USING (blob_sha) WHERE EXISTS (SELECT 1 FROM blobs b WHERE b.blob_sha = s.blob_sha AND b.parser_id = s.parser_id)", *S)(
    lambda f: snapshots.live_facts(f.symbols, f.blobs).join(f.manifest_entries, "blob_sha").select("id", "manifest_id")
)
#: Findings of each check, as subqueries.
FINDINGS = [
    ("anchors without manifest", "error", "anchors WHERE manifest_id NOT IN (SELECT manifest_id FROM manifests)"),
    ("entries without manifest", "error", "manifest_entries WHERE manifest_id NOT IN (SELECT manifest_id FROM manifests)"),
    ("entries without blob", "warn", "manifest_entries WHERE blob_sha NOT IN (SELECT blob_sha FROM blobs)"),
    ("blobs in no manifest", "info", "blobs WHERE blob_sha NOT IN (SELECT blob_sha FROM manifest_entries)"),
    ("analyzed blobs without revision", "warn", "blobs WHERE analyzer_id IS NOT NULL AND analyzer_revision IS NULL"),
    ("symbols without blob", "error", "symbols s WHERE NOT EXISTS (SELECT 1 FROM blobs b WHERE b.blob_sha = s.blob_sha AND b.parser_id = s.parser_id)"),
    ("symbols without parent", "error", "symbols WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM symbols)"),
    ("symbols that end before they start", "error", "symbols WHERE byte_end < byte_start OR line_end < line_start"),
    ("references without enclosing symbol", "error", "refs WHERE enclosing_id IS NOT NULL AND enclosing_id NOT IN (SELECT id FROM symbols)"),
    ("references without blob", "error", "refs r WHERE NOT EXISTS (SELECT 1 FROM blobs b WHERE b.blob_sha = r.blob_sha AND b.parser_id = r.parser_id)"),
    ("resolutions without path", "error", "resolutions WHERE target_symbol_id IS NOT NULL AND target_path IS NULL"),
    ("resolutions without symbol", "warn", "resolutions WHERE target_symbol_id IS NOT NULL AND target_symbol_id NOT IN (SELECT id FROM symbols)"),
    ("parser drift", "warn", "w LEFT JOIN blobs b USING (blob_sha, parser_id) WHERE b.parser_revision IS NULL OR b.parser_revision <> w.parser_revision"),
    ("failed runs", "warn", "runs WHERE status IN ('failed', 'timed_out')"),
    ("runs without manifest", "info", "runs WHERE manifest_id NOT IN (SELECT manifest_id FROM manifests)"),
    ("active runs without job", "warn", "runs WHERE status IN ('queued', 'running') AND job_id IS NULL"),
    ("runs that end before they start", "error", "runs WHERE finished_at_ns < started_at_ns"),
    ("ended runs without an end", "error", "runs WHERE status NOT IN ('queued', 'running') AND finished_at_ns IS NULL"),
    ("reconcile states ahead", "error", "reconcile_state WHERE applied > desired OR attempt > desired"),
    ("failed watchers", "warn", "reconcile_state WHERE watcher_state = 'failed' OR watcher_error IS NOT NULL"),
    ("repeated failures", "warn", "reconcile_state WHERE consecutive_failures >= 3"),
    ("states that never succeeded", "info", "reconcile_state WHERE last_success_ns IS NULL"),
]
query(
    "m5_doctor",
    f"WITH {WANTED}, n AS (" + " UNION ALL ".join(f"SELECT '{check}' AS \"check\", '{level}' AS bad, (SELECT count(*) FROM {rows}) AS findings" for check, level, rows in FINDINGS) + ') SELECT "check", CASE WHEN findings > 0 THEN bad ELSE \'ok\' END AS level, findings FROM n',
    "anchors", "manifests", "manifest_entries", "blobs", "symbols", "refs", "resolutions", "runs", "reconcile_state",
)(lambda f: admin.doctor(f, _wanted(f)))

# ---- registration

MADE = """made AS (SELECT 'docs/d' || CAST(doc_id AS VARCHAR) || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.py' ELSE '.md' END AS path, CAST(doc_id AS BIGINT) AS doc_id,
  CASE doc_id % 5 WHEN 1 THEN 'def f' || CAST(doc_id AS VARCHAR) || '(): pass' || chr(10) ELSE '# Doc' || chr(10) || coalesce(text, '') END AS content FROM documents WHERE doc_id IS NOT NULL)"""
UNITS = """unit AS (SELECT path, doc_id, sha1(encode('blob ' || CAST(strlen(content) AS VARCHAR)) || '\\x00'::BLOB || encode(content)) AS blob_sha,
  CASE doc_id % 5 WHEN 1 THEN 'tree-sitter-python' ELSE 'markdown' END AS parser_id FROM made WHERE doc_id % 5 <> 0)"""


def _files(f: Facts) -> DataFrame:
    """Files made from documents: some that no parser takes, Python functions and Markdown."""
    n = F.col("doc_id") % 5
    path = F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.when(n == 0, ".txt").when(n == 1, ".py").otherwise(".md"))
    content = F.when(n == 1, F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("(): pass\n"))).otherwise(F.concat(F.lit("# Doc\n"), F.coalesce("text", F.lit(""))))
    data = F.encode(content, "UTF-8")
    return f.documents.filter("doc_id IS NOT NULL").select(path.alias("path"), text.git_sha(data).alias("blob_sha"), data.alias("content"))


def _registered(f: Facts) -> register.Store:
    store = register.Store(f.spark, new_path(f.spark, "store"))
    register.register_files(store, _files(f), "tentative/1", 1)
    return store


def _first(f: Facts) -> DataFrame:
    store = _registered(f)
    entries = snapshots.entries_of(store.manifest_entries, snapshots.resolve(store.anchors, "tentative/1"))
    return entries.join(store.blobs, "blob_sha").select("path", "blob_sha", "parser_id", "generation")


def _second(f: Facts) -> DataFrame:
    """Registered again with changed Markdown files: their units alone are parsed."""
    store = _registered(f)
    changed = F.col("path").rlike("[37][.]md$")
    data = F.when(changed, F.concat("content", F.lit(b"\nmore"))).otherwise(F.col("content"))
    register.register_files(store, _files(f).withColumn("content", data).withColumn("blob_sha", text.git_sha(F.col("content"))), "tentative/1", 2)
    entries = snapshots.entries_of(store.manifest_entries, snapshots.resolve(store.anchors, "tentative/1"))
    return entries.join(store.blobs, "blob_sha").select("path", "blob_sha", "parser_id", "generation")


def _compacted(f: Facts) -> DataFrame:
    """The second registration's files from tables that were written anew: units that it replaced are not among them."""
    store = _registered(f)
    changed = F.col("path").rlike("[37][.]md$")
    data = F.when(changed, F.concat("content", F.lit(b"\nmore"))).otherwise(F.col("content"))
    register.register_files(store, _files(f).withColumn("content", data).withColumn("blob_sha", text.git_sha(F.col("content"))), "tentative/1", 2)
    store.compact()
    entries = snapshots.entries_of(store.manifest_entries, snapshots.resolve(store.anchors, "tentative/1"))
    return entries.join(store.blobs, "blob_sha").select("path", "blob_sha", "parser_id", "generation")


query("m1_register", f"WITH {MADE}, {UNITS} SELECT path, u.blob_sha, p.parser_id, 1 AS generation FROM unit u JOIN (SELECT DISTINCT blob_sha, parser_id FROM unit) p USING (blob_sha)")(_first)
query(
    "m1_reuse",
    f"""WITH {MADE}, old AS (SELECT DISTINCT blob_sha, parser_id FROM ({UNITS.replace('unit AS (', '', 1)}),
changed AS (SELECT path, doc_id, CASE WHEN regexp_matches(path, '[37][.]md$') THEN content || chr(10) || 'more' ELSE content END AS content FROM made),
{UNITS.replace('FROM made', 'FROM changed')}
SELECT path, u.blob_sha, p.parser_id, CASE WHEN old.blob_sha IS NULL THEN 2 ELSE 1 END AS generation
FROM unit u JOIN (SELECT DISTINCT blob_sha, parser_id FROM unit) p USING (blob_sha) LEFT JOIN old ON old.blob_sha = p.blob_sha AND old.parser_id = p.parser_id""",
)(_second)
SQL["m1_compacted"], QUERIES["m1_compacted"] = SQL["m1_reuse"], _compacted
query(
    "m1_registered_symbols",
    f"WITH {MADE} SELECT path, 'f' || CAST(doc_id AS VARCHAR) AS qualified, 'function' AS kind, 'def f' || CAST(doc_id AS VARCHAR) || '()' AS signature FROM made WHERE doc_id % 5 = 1 ORDER BY path LIMIT 100000",
)(lambda f: lookup.find_symbols(store := _registered(f), snapshots.resolve(store.anchors, "tentative/1"), kind="function", limit=100000).select("path", "qualified", "kind", "signature"))

# ---- freshness

STALE = """CASE WHEN NOT regexp_matches(anchor_name, '^tentative/[0-9]+$') THEN 'missing_tentative_snapshot' WHEN attempt IS NOT NULL THEN 'reconcile_in_progress' WHEN desired <> applied THEN 'reconcile_generation_gap'
  WHEN watcher_error IS NOT NULL OR watcher_state = 'failed' THEN 'watcher_failed' WHEN watcher_state <> 'active' THEN 'watcher_inactive' WHEN last_success_ns IS NULL THEN 'never_reconciled'
  WHEN 1500000000000 - last_success_ns > 1000000000000 THEN 'snapshot_scan_too_old' WHEN reconcile_generation IS NULL THEN 'missing_publication_receipt' WHEN reconcile_generation <> applied THEN 'publication_generation_mismatch' END"""


def _freshness(f: Facts) -> DataFrame:
    from sparkloom.streaming.freshness import stale_reason, status_label

    rows = f.reconcile_state.withColumn("reason", stale_reason(F.lit(1_500_000_000_000), 1_000_000_000_000))
    return rows.select("repo_hash", "reason", status_label(F.col("reason")).alias("status"))


query(
    "t13_freshness",
    f"SELECT repo_hash, {STALE} AS reason, CASE WHEN {STALE} IS NULL THEN 'current' WHEN {STALE} IN ('reconcile_in_progress', 'reconcile_generation_gap') THEN 'reconciling' ELSE 'stale' END AS status FROM reconcile_state",
    "reconcile_state",
)(_freshness)


def _due(f: Facts) -> DataFrame:
    from sparkloom.streaming.freshness import periodic_due

    return periodic_due(f.watched, f.reconcile_state, 1_000_000_000_000, 300_000_000_000).select("repo_hash", "last_success_ns")


query(
    "t11_periodic_due",
    "SELECT s.repo_hash, last_success_ns FROM watched r JOIN reconcile_state s ON s.repo_hash = r.repo_hash WHERE r.removal_requested_at_ns IS NULL AND desired = applied AND attempt IS NULL AND (last_success_ns IS NULL OR last_success_ns <= 700000000000)",
    "reconcile_state",
    "watched",
)(_due)


#: Paths and changes of events by their id.
EVENT_PATH = """CASE event_id % 13 WHEN 0 THEN 'src/a.py' WHEN 1 THEN '.git/HEAD' WHEN 2 THEN '.git/packed-refs' WHEN 3 THEN '.git/refs/heads/x/y' WHEN 4 THEN '.git/worktrees/w/HEAD' WHEN 5 THEN '.git/worktrees/w/index'
  WHEN 6 THEN '.git/info/exclude' WHEN 7 THEN 'a/.gitignore' WHEN 8 THEN 'a/.git' WHEN 9 THEN 'node_modules/x' WHEN 10 THEN '.git/objects/ab' WHEN 11 THEN '.gitmodules' ELSE 'docs' END"""
EVENT_CHANGE = "CASE user_id % 7 WHEN 0 THEN 'create' WHEN 1 THEN 'modify' WHEN 2 THEN 'remove' WHEN 3 THEN 'rename' WHEN 4 THEN 'create_dir' WHEN 5 THEN 'remove_dir' ELSE 'overflow' END"


def _classified(f: Facts) -> DataFrame:
    from sparkloom.streaming.coalesce import classify, rescan_reason

    rows = f.events.select("event_id", F.expr(EVENT_PATH).alias("path"), F.expr(EVENT_CHANGE).alias("change"))
    return rows.select("event_id", classify(F.col("path"), F.col("change")).alias("kind"), rescan_reason(F.col("path"), F.col("change")).alias("reason"))


query(
    "t2_classified",
    f"""WITH ev AS (SELECT event_id, {EVENT_PATH} AS path, {EVENT_CHANGE} AS change FROM events),
r AS (SELECT *, CASE WHEN change = 'overflow' THEN 'backend_requested' WHEN path IN ('.git/info/exclude', 'a/.gitignore') THEN 'ignore_rules_changed'
    WHEN path = 'a/.git' AND change <> 'modify' THEN 'directory_topology_changed'
    WHEN NOT starts_with(path, '.git/') AND change IN ('rename', 'create_dir', 'remove_dir') THEN 'directory_topology_changed' END AS reason FROM ev)
SELECT event_id, reason, CASE WHEN reason IS NOT NULL THEN 'rescan' WHEN path IN ('.git/HEAD', '.git/packed-refs', '.git/worktrees/w/HEAD') THEN CASE WHEN change IN ('create', 'modify', 'rename', 'create_dir') THEN 'git' END
  WHEN path = '.git/refs/heads/x/y' THEN 'git' WHEN starts_with(path, '.git/') OR path IN ('a/.git', 'node_modules/x') THEN NULL
  WHEN change IN ('create', 'modify') THEN 'file_touched' WHEN change = 'remove' THEN 'file_deleted' END AS kind FROM r""",
)(_classified)

#: Versions as programs and servers give them.
VERSION = "CAST({0} % 2 AS STRING) || '.' || CAST({0} % 3 AS STRING) || CASE {0} % 11 WHEN 0 THEN '' WHEN 1 THEN '.x' WHEN 2 THEN '.1.0' WHEN 3 THEN '.01' ELSE '.' || CAST({0} % 5 AS STRING) END || CASE {0} % 7 WHEN 0 THEN '-rc.1' WHEN 1 THEN '+b-1' ELSE '' END"
query(
    "f17_version_classes",
    f"""WITH v AS (SELECT event_id, {VERSION.format("event_id")} AS own, {VERSION.format("user_id")} AS other FROM events),
p AS (SELECT event_id, string_split(split_part(split_part(own, '+', 1), '-', 1), '.') AS a, string_split(split_part(split_part(other, '+', 1), '-', 1), '.') AS b FROM v),
n AS (SELECT event_id, list_transform(a, lambda x: try_cast(x AS UBIGINT)) AS a, list_transform(b, lambda x: try_cast(x AS UBIGINT)) AS b FROM p)
SELECT event_id, CASE WHEN len(a) <> 3 OR len(b) <> 3 OR list_contains(list_transform(a, lambda x: x IS NULL), true) OR list_contains(list_transform(b, lambda x: x IS NULL), true) THEN 'unparseable'
  WHEN a[1] <> b[1] THEN 'major_mismatch' WHEN a[2] <> b[2] THEN 'minor_mismatch' WHEN a[3] <> b[3] THEN 'patch_mismatch' ELSE 'same_patch' END AS class FROM n""",
)(lambda f: f.events.select("event_id", text.version_class(F.expr(VERSION.format("event_id")), F.expr(VERSION.format("user_id"))).alias("class")))


def _revalidated(f: Facts) -> DataFrame:
    """The states of a query's begin and end: meanwhile a part of the repositories was scanned again, or is gone."""
    from sparkloom.streaming.freshness import revalidated, stale_reason

    before = f.reconcile_state.withColumn("reason", stale_reason(F.lit(1_500_000_000_000), 1_000_000_000_000))
    n = F.substring("repo_hash", 2, 20).cast("long")
    after = f.reconcile_state.filter(n % 14 != 0).withColumn("applied", F.when(n % 5 == 1, F.col("applied") + 1).otherwise(F.col("applied")))
    return revalidated(before, after, ["anchor_name", "applied", "reconcile_generation"]).select("repo_hash", "reason")


query(
    "t14_revalidated",
    f"""WITH b AS (SELECT *, {STALE} AS reason FROM reconcile_state), a AS (SELECT repo_hash, anchor_name, reconcile_generation, CASE WHEN CAST(substr(repo_hash, 2) AS BIGINT) % 5 = 1 THEN applied + 1 ELSE applied END AS applied
  FROM reconcile_state WHERE CAST(substr(repo_hash, 2) AS BIGINT) % 14 <> 0)
SELECT b.repo_hash, CASE WHEN b.reason IS NULL AND (a.repo_hash IS NULL OR b.anchor_name IS DISTINCT FROM a.anchor_name OR b.applied IS DISTINCT FROM a.applied OR b.reconcile_generation IS DISTINCT FROM a.reconcile_generation)
  THEN 'snapshot_changed_during_query' ELSE b.reason END AS reason FROM b LEFT JOIN a ON a.repo_hash = b.repo_hash""",
    "reconcile_state",
)(_revalidated)


def _generations(f: Facts) -> DataFrame:
    from sparkloom.streaming.generations import fold_batch

    kind = F.when(F.col("event_type") == "error", "force").when(F.col("event_type") == "signup", "immediate").otherwise("dirty")
    return fold_batch(f.events.select(F.col("user_id").cast("string").alias("repo"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), kind.alias("kind")))


query(
    "t6_generations",
    """WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS repo, epoch_us(ts) AS moment, event_id AS seq, CASE event_type WHEN 'error' THEN 'force' WHEN 'signup' THEN 'immediate' ELSE 'dirty' END AS kind FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY moment, seq) AS g FROM ev)
SELECT repo, max(g) AS desired, coalesce(max(CASE WHEN kind = 'force' THEN g END), 0) AS forced, min(moment) AS dirty_since FROM n GROUP BY repo""",
)(_generations)


def _windows(f: Facts) -> DataFrame:
    from sparkloom.streaming.coalesce import windows_batch

    return windows_batch(f.events.select(F.col("user_id").cast("string").alias("repo"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq")), 3_600_000_000)


query(
    "t5_coalesced",
    """WITH RECURSIVE ev AS (SELECT CAST(user_id AS VARCHAR) AS repo, epoch_us(ts) AS moment FROM events),
w(repo, start) AS (SELECT repo, min(moment) FROM ev GROUP BY repo
  UNION ALL SELECT w.repo, (SELECT min(moment) FROM ev WHERE ev.repo = w.repo AND ev.moment >= w.start + 3600000000) FROM w
  WHERE EXISTS (SELECT 1 FROM ev WHERE ev.repo = w.repo AND ev.moment >= w.start + 3600000000))
SELECT w.repo, w.start, (SELECT count(*) FROM ev WHERE ev.repo = w.repo AND ev.moment >= w.start AND ev.moment < w.start + 3600000000) AS events FROM w""",
)(_windows)


def _hours(f: Facts) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "rescan").when(F.col("event_type") == "signup", "file_deleted").otherwise("file_touched")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return f.events.select(F.col("user_id").cast("string").alias("repo"), F.floor(at / 86_400_000_000).alias("w"), F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")).alias("path"), kind.alias("kind"), at.alias("at"), F.col("event_id").alias("seq"))


def _collapsed(f: Facts) -> DataFrame:
    from sparkloom.streaming.coalesce import collapse

    return collapse(_hours(f), ["repo", "w"])


query(
    "t3_collapsed",
    """WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS repo, epoch_us(ts) // 86400000000 AS w, 'f' || CAST(event_id % 5 AS VARCHAR) AS path, CASE event_type WHEN 'error' THEN 'rescan' WHEN 'signup' THEN 'file_deleted' ELSE 'file_touched' END AS kind, epoch_us(ts) AS moment, event_id AS seq FROM events),
m AS (SELECT *, bool_or(kind = 'rescan') OVER (PARTITION BY repo, w) AS scan, row_number() OVER (PARTITION BY repo, w, path ORDER BY moment DESC, seq DESC) AS k FROM ev)
SELECT DISTINCT repo, w, 'rescan' AS kind, CAST(NULL AS VARCHAR) AS path FROM m WHERE scan UNION ALL SELECT repo, w, kind, path FROM m WHERE NOT scan AND k = 1""",
)(_collapsed)


def _debounced(f: Facts) -> DataFrame:
    from sparkloom.streaming.coalesce import debounced

    rows = f.events.select(F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return debounced(rows, "6 hours").select("repo", "path", F.unix_micros("start").alias("start"), "events")


query(
    "t4_debounced",
    """WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS repo, event_type AS path, epoch_us(ts) AS moment FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY repo, path ORDER BY moment ROWS UNBOUNDED PRECEDING) AS n FROM (
  SELECT *, CASE WHEN moment - lag(moment) OVER (PARTITION BY repo, path ORDER BY moment) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM ev))
SELECT repo, path, min(moment) AS start, count(*) AS events FROM g GROUP BY repo, path, n""",
)(_debounced)


def _chains(f: Facts) -> DataFrame:
    from sparkloom.plans.linearize import linearized

    edges = f.customer.filter("c_custkey > 0").select(
        F.col("c_nationkey").cast("string").alias("workspace"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("class"),
        F.concat(F.lit("C"), F.floor(F.col("c_custkey") / 3).cast("string")).alias("base"), F.lit("inherit").alias("kind"), F.lit(0).alias("ordinal"),
    )
    return linearized(edges, "kotlin")


query(
    "r7_ancestors",
    """WITH RECURSIVE e AS (SELECT CAST(c_nationkey AS VARCHAR) AS workspace, 'C' || CAST(c_custkey AS VARCHAR) AS class, 'C' || CAST(c_custkey // 3 AS VARCHAR) AS base FROM customer WHERE c_custkey > 0),
w(workspace, class, position, ancestor) AS (SELECT workspace, class, 0, class FROM (SELECT workspace, class FROM e UNION SELECT workspace, base FROM e)
  UNION ALL SELECT w.workspace, w.class, w.position + 1, e.base FROM w JOIN e ON e.workspace = w.workspace AND e.class = w.ancestor)
SELECT workspace, class, position, ancestor FROM w""",
)(_chains)



def _calls(f: Facts) -> DataFrame:
    """Calls in methods of a class for each customer, by turns through self, super() and a class of the workspace by its name."""
    from sparkloom.plans.linearize import dispatched, linearized, receiver_classes

    edges = f.customer.filter("c_custkey > 0").select(
        F.col("c_nationkey").cast("string").alias("workspace"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("class"),
        F.concat(F.lit("C"), F.floor(F.col("c_custkey") / 3).cast("string")).alias("base"), F.lit("inherit").alias("kind"), F.lit(0).alias("ordinal"),
    )
    own = edges.select("workspace", "class")
    methods = own.select("workspace", "class", F.concat(F.lit("m"), F.length("class").cast("string")).alias("method"))
    key = F.col("c_custkey")
    receiver = F.when(key % 3 == 0, "self").when(key % 3 == 1, "super()").otherwise(F.concat(F.lit("C"), (key - 25).cast("string")))
    calls = f.customer.filter("c_custkey > 0").select(
        key.alias("id"), F.col("c_nationkey").cast("string").alias("workspace"), receiver.alias("receiver"), F.concat(F.lit("C"), key.cast("string")).alias("enclosing_class"),
        F.concat(F.lit("m"), (F.length(key.cast("string")) + 1 - key % 2).cast("string")).alias("method"),
    )
    names = own.select("workspace", F.col("class").alias("name"), "class")
    return dispatched(receiver_classes(calls, names), linearized(edges, "python"), methods).select("id", "receiver", "method", "class", "owner")


query(
    "r4_dispatched_calls",
    """WITH RECURSIVE e AS (SELECT CAST(c_nationkey AS VARCHAR) AS workspace, 'C' || CAST(c_custkey AS VARCHAR) AS class, 'C' || CAST(c_custkey // 3 AS VARCHAR) AS base FROM customer WHERE c_custkey > 0),
w(workspace, class, position, ancestor) AS (SELECT workspace, class, 0, class FROM (SELECT workspace, class FROM e UNION SELECT workspace, base FROM e)
  UNION ALL SELECT w.workspace, w.class, w.position + 1, e.base FROM w JOIN e ON e.workspace = w.workspace AND e.class = w.ancestor),
c AS (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS workspace, CASE c_custkey % 3 WHEN 0 THEN 'self' WHEN 1 THEN 'super()' ELSE 'C' || CAST(c_custkey - 25 AS VARCHAR) END AS receiver,
  'C' || CAST(c_custkey AS VARCHAR) AS enclosing, 'm' || CAST(length(CAST(c_custkey AS VARCHAR)) + 1 - c_custkey % 2 AS VARCHAR) AS method FROM customer WHERE c_custkey > 0),
t AS (SELECT c.*, CASE WHEN receiver IN ('self', 'super()') THEN enclosing ELSE e.class END AS class, CASE WHEN receiver = 'super()' THEN 0 ELSE -1 END AS after
  FROM c LEFT JOIN e ON e.workspace = c.workspace AND e.class = c.receiver)
SELECT t.id, t.receiver, t.method, t.class, min_by(w.ancestor, w.position) AS owner
FROM t LEFT JOIN (SELECT w.* FROM w JOIN e ON e.workspace = w.workspace AND e.class = w.ancestor) w
  ON w.workspace = t.workspace AND w.class = t.class AND w.position > t.after AND 'm' || CAST(length(w.ancestor) AS VARCHAR) = t.method
GROUP BY ALL""",
)(_calls)

#: Imports of all forms, by the ids of the fact table; names are those of modules and symbols, and others.
IMPORT_TARGET = "CASE id % 7 WHEN 0 THEN 'Shared.s' || CAST(id % 50 AS STRING) WHEN 1 THEN '.' WHEN 2 THEN 's' || CAST(id % 40 AS STRING) WHEN 3 THEN '..deep.s' || CAST(id % 30 AS STRING) WHEN 4 THEN 'nowhere' WHEN 5 THEN '.s' || CAST(id % 20 AS STRING) ELSE '....' END"
IMPORT_NAME = "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN 's' || CAST(id % 60 AS STRING) WHEN id % 7 = 5 AND id % 2 = 0 THEN '*' WHEN id % 3 = 0 THEN 'none' ELSE name END"


def _imports(f: Facts) -> DataFrame:
    from sparkloom.plans.imports import resolve_imports

    entries = snapshots.entries_of(f.manifest_entries, HEAD)
    files = entries.select("path", text.module_of(F.col("path")).alias("module"), F.lit(False).alias("is_package"))
    symbols = f.symbols.join(entries, "blob_sha").withColumn("module", text.module_of(F.col("path")))
    symbols = symbols.select("path", F.concat("module", F.lit("."), "name").alias("qualified"), (F.col("kind") == "class").alias("is_class"), F.col("byte_start").alias("place"))
    # one file for each import, and a name that some symbol of the workspace may have
    first = entries.groupBy("blob_sha").agg(F.min("path").alias("path"))
    names = f.symbols.groupBy("blob_sha").agg(F.min("name").alias("name"))
    rows = f.imports.select("id", "blob_sha").join(first, "blob_sha").join(names, "blob_sha", "left")
    rows = rows.select("id", "path", F.expr(IMPORT_TARGET).alias("target"), F.expr(IMPORT_NAME).alias("name"))
    return resolve_imports(rows, files, symbols)


SUFFIXES = "list_transform(range(1, len(string_split({0}, '.')) + 1), lambda k: array_to_string(list_slice(string_split({0}, '.'), k, len(string_split({0}, '.'))), '.'))"
query(
    "r2_python_imports",
    f"""WITH {FILES}, fi AS (SELECT path, replace(left(path, length(path) - 3), '/', '.') AS module FROM e),
mi AS (SELECT key, min(path) AS path FROM (SELECT path, unnest({SUFFIXES.format("module")}) AS key FROM fi) GROUP BY 1),
sy AS (SELECT path, module || '.' || name AS qualified, kind = 'class' AS is_class, byte_start AS place FROM symbols JOIN e USING (blob_sha) JOIN fi USING (path)),
si AS (SELECT key, path, qualified FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY path, NOT is_class, place, qualified, length(qualified) - length(key)) AS k
  FROM (SELECT *, unnest({SUFFIXES.format("qualified")}) AS key FROM sy)) WHERE k = 1),
im AS (SELECT id, fi.path, module, {IMPORT_TARGET} AS target, {IMPORT_NAME} AS name
  FROM imports i JOIN (SELECT blob_sha, min(path) AS path FROM e GROUP BY 1) USING (blob_sha) JOIN fi USING (path) LEFT JOIN (SELECT blob_sha, min(name) AS name FROM symbols GROUP BY 1) USING (blob_sha)),
lv AS (SELECT *, length(regexp_extract(target, '^[.]*')) AS dots, regexp_replace(target, '^[.]+', '') AS rest, string_split(module, '.') AS parts FROM im),
ab AS (SELECT *, CASE WHEN dots = 0 THEN target WHEN len(parts) >= dots THEN array_to_string(list_filter([nullif(array_to_string(parts[1:len(parts) - dots], '.'), ''), nullif(rest, '')], lambda x: x IS NOT NULL), '.') END AS base FROM lv),
tr AS (SELECT id, 0 AS rank, target AS key, false AS sym, true AS mod, false AS any FROM ab WHERE name IS NULL
  UNION ALL SELECT id, 0, base, false, false, true FROM ab WHERE name = '*'
  UNION ALL SELECT id, 0, base || '.' || name, true, true, false FROM ab WHERE name <> '*' AND base IS NOT NULL
  UNION ALL SELECT id, 1, name, true, false, false FROM ab WHERE name <> '*' AND base IS NOT NULL
  UNION ALL SELECT id, 2, base, false, true, false FROM ab WHERE name <> '*' AND base IS NOT NULL),
hit AS (SELECT tr.id, coalesce(si.path, mi.path) AS target_path, coalesce(si.qualified, tr.key) AS target_qualified, row_number() OVER (PARTITION BY tr.id ORDER BY rank) AS k
  FROM tr LEFT JOIN mi USING (key) LEFT JOIN si USING (key) WHERE key IS NOT NULL AND (tr.any OR (sym AND si.path IS NOT NULL) OR (mod AND mi.path IS NOT NULL)))
SELECT im.id, im.path, im.target, im.name, target_path, target_qualified FROM im LEFT JOIN hit ON hit.id = im.id AND k = 1""",
    "imports", "symbols", "manifest_entries",
)(_imports)



def _exports(f: Facts) -> DataFrame:
    """A file for each supplier: every seventh defines x, others pass it on from the file of half their number, some in a circle; an import for each order."""
    from sparkloom.plans.imports import resolve_exports
    from sparkloom.plans.linearize import relative_specifiers

    k = F.col("s_suppkey")
    file = lambda n: F.concat(F.lit("lib/f"), n.cast("string"), F.lit(".js"))
    to = F.when(k % 11 == 5, k + 1).when(k % 11 == 6, k - 1).otherwise(F.floor(k / 2))
    passed = f.supplier.filter((k % 7 != 0) & (k > 1)).select(file(k).alias("path"), F.lit("x").alias("name"), file(to).alias("to_path"), F.lit("x").alias("to_name"))
    own = f.supplier.filter(k % 7 == 0).select(file(k).alias("path"), F.lit("x").alias("name"), F.lit("X").alias("local"))
    symbols = f.supplier.filter(k % 14 == 0).select(file(k).alias("path"), F.lit("X").alias("qualified"))
    o = F.col("o_orderkey")
    specifier = F.when(o % 9 == 0, "react").otherwise(F.concat(F.lit("./f"), (F.col("o_custkey") % F.lit(f.supplier.count())).cast("string")))
    rows = f.orders.select(o.alias("id"), F.lit("lib/main.js").alias("path"), specifier.alias("specifier"), F.when(o % 5 == 0, None).when(o % 7 == 0, "y").otherwise("x").alias("name"))
    found = relative_specifiers(rows, f.supplier.select(file(k).alias("path")))
    return resolve_exports(found, own, symbols, passed)


query(
    "r10_javascript_exports",
    """WITH RECURSIVE r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 5 THEN s_suppkey + 1 WHEN s_suppkey % 11 = 6 THEN s_suppkey - 1 ELSE s_suppkey // 2 END AS too FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey > 1),
w(k, ep, hops) AS (SELECT k, too, 1 FROM r UNION ALL SELECT w.k, r.too, hops + 1 FROM w JOIN r ON r.k = w.ep WHERE hops < 8),
e AS (SELECT w.k, max_by(w.ep, hops) AS ep FROM w GROUP BY w.k),
c AS (SELECT e.k, e.ep, r.k IS NOT NULL AS dropped FROM e LEFT JOIN r ON r.k = e.ep),
i AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'react' ELSE './f' || CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) END AS specifier,
  CASE WHEN o_orderkey % 9 <> 0 AND o_custkey % (SELECT count(*) FROM supplier) IN (SELECT s_suppkey FROM supplier) THEN o_custkey % (SELECT count(*) FROM supplier) END AS k,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'y' ELSE 'x' END AS name FROM orders),
m AS (SELECT i.*, i.k % 14 = 0 AND name = 'x' AS own, c.ep, coalesce(c.dropped, false) AS gone FROM i LEFT JOIN c ON c.k = i.k AND i.name = 'x')
SELECT id, coalesce(gone, false) AS dropped,
  CASE WHEN k IS NOT NULL AND NOT gone THEN 'lib/f' || CAST(CASE WHEN own THEN k ELSE coalesce(ep, k) END AS VARCHAR) || '.js' END AS target_path,
  CASE WHEN k IS NULL THEN concat_ws('.', specifier, name) WHEN name IS NULL THEN 'lib/f' || CAST(k AS VARCHAR) || '.js' WHEN own THEN 'X' WHEN gone THEN NULL WHEN ep IS NOT NULL AND ep % 14 = 0 THEN 'X' ELSE name END AS target_qualified
FROM m""",
)(_exports)

# ---- scoring

CASES = """x AS (SELECT 'case' || CAST(doc_id % 20 AS VARCHAR) AS "case", 'f' || CAST(doc_id % 7 AS VARCHAR) AS path, doc_id AS line, CASE doc_id % 3 WHEN 0 THEN 'A::b' WHEN 1 THEN 'A.b' ELSE '::A' || chr(92) || 'b' END AS target_qualified, quality, toxic FROM labels)"""


def _cases(f: Facts) -> DataFrame:
    target = F.when(F.col("doc_id") % 3 == 0, "A::b").when(F.col("doc_id") % 3 == 1, "A.b").otherwise("::A\\b")
    return f.labels.select(F.concat(F.lit("case"), (F.col("doc_id") % 20).cast("string")).alias("case"), F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")).alias("path"), F.col("doc_id").alias("line"), target.alias("target_qualified"), "quality", "toxic")


def _scores(f: Facts) -> DataFrame:
    cases = _cases(f)
    return evaluate.scored(cases.filter("quality = 1"), cases.filter("toxic = 1"))


SCORES = f"""WITH {CASES}, k AS (SELECT "case", path, line, {NORMAL.format("target_qualified")} AS target, max(quality = 1) AS e, max(toxic = 1) AS a FROM x GROUP BY ALL HAVING max(quality = 1) OR max(toxic = 1)),
s AS (SELECT "case", count(*) FILTER (e AND a) AS hits, count(*) FILTER (e AND NOT a) AS missing, count(*) FILTER (a AND NOT e) AS extra FROM k GROUP BY 1)
SELECT *, CASE WHEN hits + extra > 0 THEN hits / (hits + extra) WHEN hits + missing > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS precision, CASE WHEN hits + missing > 0 THEN hits / (hits + missing) ELSE 1.0::DOUBLE END AS recall FROM s"""
query("a10_scores", SCORES)(_scores)
query("a11_medians", "SELECT event_type AS operation, median(value) AS ms FROM events GROUP BY 1")(lambda f: evaluate.medians(f.events.select(F.col("event_type").alias("operation"), F.col("value").alias("ms"))))
query(
    "a12_missing_extra",
    """SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT ALL SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT ALL SELECT doc_id FROM labels WHERE quality = 1)""",
)(lambda f: evaluate.missing_and_extra(f.labels.filter("quality = 1").select("doc_id"), f.labels.filter("toxic = 1").select("doc_id")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Facts(spark, sf_dir, indexed=False))) for name, f in QUERIES.items()}
