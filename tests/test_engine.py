"""Query verbs against hand-made rows and their SQL twins, plans, and event state machines."""

import random
import re
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom import queries
from sparkloom.functions import fts
from sparkloom.operators import admin, enclosing, extract, lookup, repos
from sparkloom.plans import bindings, snapshots
from sparkloom.plans.bindings import RAW, Facts
from sparkloom.streaming import coalesce, generations

SF = "/root/testdata/sf0.001"


def store(spark, **tables):
    schemas = {
        "symbols": "id long, blob_sha string, parser_id string, parent_id long, name string, qualified string, kind string, signature string, visibility string, doc string, byte_start long, byte_end long, line_start long, line_end long, source string, scope string",
        "refs": "id long, blob_sha string, parser_id string, enclosing_id long, target_name string, target_qualified string, kind string, byte_start long, byte_end long, line long, source string",
        "implementations": "id long, blob_sha string, parser_id string, type_qualified string, interface_qualified string, kind string, line long, syntactic_kind string, interface_byte_start long, interface_byte_end long",
        "imports": "id long, blob_sha string, parser_id string, to_module string, imported string, alias string, is_reexport boolean, line long, byte_start long, byte_end long",
        "resolutions": "id long, site_blob_sha string, site_parser_id string, site_byte_start long, site_byte_end long, kind string, semantic_kind string, target_symbol_id long, source string, target_path string, manifest_id long",
        "blobs": "blob_sha string, parser_id string, parser_revision int, parsed_at_ns long, analyzer_id string, analyzer_revision int",
        "manifest_entries": "manifest_id long, path string, blob_sha string",
        "anchors": "anchor_name string, manifest_id long, last_updated_ns long, reconcile_generation long",
    }
    return SimpleNamespace(**{n: spark.createDataFrame(tables.get(n, []), s) for n, s in schemas.items()})


def symbol(i, name, scope="top_level", a=0, b=100, line=1, parser="p", blob="b", qualified=None):
    return (i, blob, parser, None, name, qualified or name, "function", None, None, None, a, b, line, line + 3, "tier1", scope)


def test_scope_and_outline(spark):
    f = store(spark, symbols=[symbol(1, "outer"), symbol(2, "helper", "nested", 20, 60, 2, qualified="outer.helper")], blobs=[("b", "tree-sitter-javascript", 1, 0, None, None)], manifest_entries=[(1, "src/app.js", "b")])
    assert lookup.find_symbols(f, 1, "helper").count() == 0 and lookup.find_symbols(f, 1, "outer").count() == 1
    assert [r.name for r in lookup.get_outline(f, 1, "src/app.js").collect()] == ["outer", "helper"]
    assert lookup.find_symbols(f, 1, "outer", kind="", container="", path="").count() == 1  # empty filters filter nothing
    for empty in ({}, {"query": "", "kind": ""}):
        with pytest.raises(ValueError):
            lookup.find_symbols(f, 1, **empty)


def test_physical_declarations(spark):
    rows = [symbol(1, "same", parser="z", b=10, qualified="crate::same"), symbol(2, "same", parser="a", b=10, qualified="crate::same"), symbol(3, "same", parser="a", a=20, b=30, line=3, qualified="crate::same")]
    f = store(spark, symbols=rows, blobs=[("b", "a", 1, 0, None, None)], manifest_entries=[(1, "x.rs", "b")])
    got = lookup.symbol_source_rows(f, 1, "crate::same").collect()
    assert [(r.symbol_id, r.parser_id, r.byte_start) for r in got] == [(2, "a", 0), (3, "a", 20)]
    assert lookup.symbol_source_rows(f, 1, "crate::same", "x.rs", 1).count() == 1 and lookup.symbol_source_rows(f, 1, "crate::same", "y.rs").count() == 0
    contents = spark.createDataFrame([("b", b"0123456789abcdefghijKLMNOPQRST")], "blob_sha string, content binary")
    with pytest.raises(lookup.AmbiguousSource):
        lookup.get_symbol_source(f, contents, 1, "crate::same")
    assert lookup.get_symbol_source(f, contents, 1, "crate::same", "x.rs", 3).first().source_text == "KLMNOPQRST"
    with pytest.raises(LookupError):
        lookup.get_symbol_source(f, contents, 1, "none")


def test_resolutions_of_bases(spark):
    impl = [(1, "b", "p", "Dog", "Animal", "trait", 5, None, 10, 20), (2, "b", "p", "Cat", "Animal", "inherit", 6, None, None, None)]
    res = [
        (1, "b", "p", 10, 20, "call", None, None, "tier3-x", None, None),
        (2, "b", "p", 10, 20, "type", None, None, "tier25-x", None, None),
        (3, "b", "p", 10, 20, "type", "inherit", None, "tier3-x", None, 2),
        (4, "b", "p", 10, 20, "type", "mixin", None, "rust-syn", "t.py", 1),
    ]
    f = store(spark, implementations=impl, resolutions=res, manifest_entries=[(1, "a.py", "b"), (2, "a.py", "b"), (3, "a.py", "b")])
    kinds = lambda m: [(r.type_qualified, r.kind, r.kind_source, r.target_path) for r in lookup.find_subtypes(f, m, "Animal").collect()]
    assert kinds(1) == [("Dog", "mixin", "rust-syn", "t.py"), ("Cat", "inherit", "tier2-fact", None)]
    assert kinds(2)[0] == ("Dog", "inherit", "tier3-x", None)
    assert kinds(3)[0] == ("Dog", "trait", "tier25-x", None)  # without a meaning of its own the fact's kind stays
    assert lookup.find_supertypes(f, 1, "Dog").first().interface_qualified == "Animal"


def test_references(spark):
    symbols = [symbol(1, "go", qualified="app.go"), symbol(2, "main", qualified="app.main")]
    refs = [
        (1, "b", "p", 2, "go", None, "call", 10, 12, 3, "tier2"),
        (2, "b", "p", 2, "go", "app.go", "call", 10, 12, 3, "tier2"),
        (3, "b", "p", 2, "go", "", "call", 0, 0, 3, "tier2"),
        (4, "b", "p", 2, "go", None, "call", 30, 32, 3, "tier3-x"),
        (5, "b", "p", None, "go", None, "instantiate", 50, 52, 9, "tier2"),
    ]
    res = [(1, "b", "p", 30, 32, "call", None, 1, "tier3-x", "a.py", 1), (2, "b", "p", 50, 52, "instantiate", None, 1, "tier3-x", "a.py", 1)]
    f = store(spark, symbols=symbols, refs=refs, resolutions=res, manifest_entries=[(1, "a.py", "b")])
    ids = lambda df: [(r.line, r.target_qualified, r.kind_source) for r in df.collect()]
    assert ids(lookup.find_references(f, 1, "go")) == [(3, "app.go", "tier2-fact"), (3, "app.go", "tier3-x"), (9, None, "tier2-fact")]
    assert len(ids(lookup.find_references(f, 1, "go", include_noise=True))) == 5
    assert ids(lookup.find_references(f, 1, "app.go")) == [(3, "app.go", "tier2-fact"), (3, "app.go", "tier3-x")]
    assert len(ids(lookup.find_references(f, 1, "other.go"))) == 3  # falls back to the bare name
    assert len(ids(lookup.find_callees(f, 1, "app.main"))) == 2 and ids(lookup.references_outgoing(f, 1, "app.main", kind="type")) == []
    with pytest.raises(ValueError):
        lookup.find_references(f, 1, " ")


def test_outgoing_references_of_a_kind(spark):
    symbols = [symbol(1, "Gear", qualified="app.Gear"), symbol(2, "main", qualified="app.main"), symbol(3, "other", qualified="app.other")]
    refs = [
        (1, "b", "p", 2, "Gear", None, "type", 10, 14, 3, "tier2"),
        (2, "b", "p", 2, "Gear", "app.Gear", "type", 10, 14, 3, "tier2"),
        (3, "b", "p", 2, "Gear", None, "type", 30, 34, 4, "tier2"),
        (4, "b", "p", 2, "Gear", "", "type", 50, 54, 5, "tier2"),
        (5, "b", "p", 2, "Gear", "app.Gear", "type", 0, 0, 6, "tier2"),
        (6, "b", "p", 2, "Gear", "app.Gear", "type", 60, 64, 6, "tier3-x"),
        (7, "b", "p", 2, "go", "app.go", "call", 80, 82, 7, "tier2"),
        (8, "b", "p", 2, "Gear", "app.Gear", "instantiate", 90, 94, 8, "tier2"),
        (9, "b", "p", 3, "Gear", "app.Gear", "type", 100, 104, 9, "tier2"),
    ]
    f = store(spark, symbols=symbols, refs=refs, resolutions=[(1, "b", "p", 30, 34, "type", None, 1, "tier3-x", "a.py", 1)], manifest_entries=[(1, "a.py", "b")])
    of = lambda *a, **b: [(r.line, r.target_qualified, r.kind_source) for r in lookup.find_references(f, 1, "app.main", "outgoing", *a, **b).collect()]
    # neither one that leads nowhere, nor one without a range that another stands for, nor one of two on a range
    assert of("type") == [(3, "app.Gear", "tier2-fact"), (4, "app.Gear", "tier3-x"), (6, "app.Gear", "tier2-fact")]
    assert of("type", limit=2) == of("type")[:2] and [x[0] for x in of("type", include_noise=True)] == [3, 3, 4, 5, 6, 6]
    assert [x[0] for x in of("instantiate")] == [8] and of("import") == []
    assert [x[0] for x in of()] == [x[0] for x in of("call")] == [7]  # only calls unless a kind is asked for


def test_outgoing_types_equal_their_sql_and_are_some(spark):
    c = duckdb.connect()
    for t in RAW:
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    want = c.execute(queries.SQL["q8_references_outgoing_type"])
    columns = [d[0] for d in want.description]
    got = queries.queries()["q8_references_outgoing_type"](spark, "/root/testdata/sf0.01").select(columns).collect()
    assert [tuple(r) for r in got] == want.fetchall() and {r.kind for r in got} == {"type"}


def test_anchors(spark):
    f = store(spark, anchors=[("HEAD", 1, 0, None), ("tentative/2", 3, 0, None), ("tentative/10", 2, 0, None)])
    assert snapshots.default_anchor(f.anchors) == "tentative/10" and snapshots.default_anchor(f.anchors, branch="x") == "branch/x"
    assert snapshots.resolve(f.anchors, "HEAD") == 1
    with pytest.raises(snapshots.AnchorNotFound):
        snapshots.resolve(f.anchors, "none")
    assert snapshots.resolve(snapshots.upsert_anchor(f.anchors, "HEAD", 9, 1), "HEAD") == 9
    with pytest.raises(ValueError):
        admin.prune_blobs(f.blobs, [])


@pytest.mark.parametrize("long", [500_000, 0, 20])
def test_windows_of_many_repositories_against_a_loop(spark, monkeypatch, long):
    monkeypatch.setattr(coalesce, "LONG_STRETCH", long)
    rnd = random.Random(3)
    ticks = [(f"r{r}", at + rnd.choice([0, 0, 0, 5000])) for r in range(6) for at in rnd.choices(range(-400, 4000 * (r + 1)), k=120 * (r % 3 + 1))] + [("one", -7)]
    ticks += [("even", 100 * k) for k in range(300)]
    want = []
    for repo in sorted({r for r, _ in ticks}):
        start = None
        for at in sorted(a for r, a in ticks if r == repo):
            if start is None or at >= start + 100:
                start = at
                want.append([repo, start, 0])
            want[-1][2] += 1
    frame = spark.createDataFrame(ticks, "repo string, at long").repartition(5)
    assert sorted(map(list, coalesce.windows_batch(frame, 100).collect())) == sorted(want)


def test_hints_and_docs(spark):
    f = store(spark, symbols=[symbol(1, "Card"), symbol(2, "lower")], manifest_entries=[(1, "ui/card.tsx", "b"), (2, "card.py", "b")])
    assert "instantiate" in lookup.caller_hint(f, 1, "Card") and lookup.caller_hint(f, 2, "Card") is None and lookup.caller_hint(f, 1, "lower") is None
    said = repos.diagnostics({"reason": "capped", "states": ["running", "failed"], "rows": [], "kind": "class"})
    assert len(said) == 4 and repos.diagnostics({"rows": [1]}) == []
    docs = spark.createDataFrame([("b", "p", "Card", "class", "new"), ("b", "p", "Card", "impl", "other")], "blob_sha string, parser_id string, qualified string, kind string, doc string")
    rows = spark.createDataFrame([("b", "p", "Card", "class", "old"), ("b", "p", "Card", "method", "kept")], "blob_sha string, parser_id string, qualified string, kind string, doc string")
    assert {r.kind: r.doc for r in extract.with_doc_overrides(rows, docs).collect()} == {"class": "new", "method": "kept"}


def test_limits_and_completeness(spark):
    assert lookup.probe(spark.range(5), 5)[1] is False and lookup.probe(spark.range(6), 5)[1] is True
    assert lookup.completeness(True, True, False) == ("partial", "stale") and lookup.completeness(False, False, False) == ("complete", None)


@pytest.mark.parametrize("name", ["q6_references_bare", "q7_references_strict", "q8_references_outgoing", "w1_best_resolution", "j7_enclosing_by_bytes"])
def test_no_growing_table_meets_in_one_task(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_filter_the_layout_of_their_key(spark):
    f = Facts(spark, SF)
    by_name = plan_of(lookup.find_symbols(f, 0, "red_widget"))
    assert "EqualTo(name,red_widget)" in by_name and "EqualTo(qualified,red_widget)" in by_name and "symbols_by_name" in by_name
    words = plan_of(lookup.find_symbols(f, 0, 'wid* "part small" red', fuzzy=True))
    assert "StringStartsWith(token,wid)" in words and "EqualTo(token,red)" in words and "regexp" not in words.lower()
    ids = [r.id for r in f.symbols.limit(3).collect()]
    outgoing = lookup.at_keys(lookup.second(f, "refs_by_enclosing"), "enclosing_id", ids)
    assert re.search(r"PushedFilters: \[.*In\(enclosing_id", plan_of(outgoing)) and all("refs_by_enclosing" in x for x in outgoing.inputFiles())


LOOKUPS = ["q12_find_callers", "q3_find_supertypes", "q7_references_fallback", "q8_references_outgoing_type", "q6_references_many", "q8_references_outgoing_noise"]


@pytest.mark.parametrize("name", LOOKUPS)
def test_a_single_lookup_writes_no_index_of_large_tables(spark, monkeypatch, name):
    monkeypatch.setattr(bindings, "_WRITTEN", {})
    got = sorted(map(str, queries.queries()[name](spark, SF).collect()))
    assert {k[2] for k in bindings._WRITTEN} <= {"refs", "symbols", "symbols_by_id", "symbols_by_name", "manifest_entries"}
    assert got == sorted(map(str, queries.QUERIES[name](Facts(spark, SF)).collect()))


@pytest.mark.parametrize("name", ["p11_source_rank", "q23_snippets"])
def test_what_reads_references_once_writes_none(spark, monkeypatch, name):
    monkeypatch.setattr(bindings, "_WRITTEN", {})
    assert queries.queries()[name](spark, SF).count() and not bindings._WRITTEN


def test_bindings_read_alike_with_numbers_as_literals(spark):
    f = Facts(spark, SF, indexed=False)
    for name in ("refs", "resolutions", "implementations", "imports"):
        plain = spark.sql(bindings.BINDINGS[name], **{x: getattr(f, x) for x in dict.fromkeys(re.findall(r"\{(\w+)\}", bindings.BINDINGS[name]))})
        here = f.derived(name)
        assert here.schema.simpleString() == plain.schema.simpleString() and here.exceptAll(plain).isEmpty() and here.count() == plain.count()
        assert "NestedLoop" not in plan_of(here) and "Cartesian" not in plan_of(here)


def test_snippets_meet_lines_not_contents(spark):
    hits = spark.createDataFrame([(i, b, n) for i, (b, n) in enumerate([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 0), ("a", -1), ("a", None), ("b", 1), ("c", 1), (None, 1), ("a", 2)])], "id long, blob_sha string, line long")
    contents = spark.createDataFrame([("a", "x\r\r\n\ny\n"), ("b", None), ("d", "z")], "blob_sha string, content string")
    got = lookup.with_snippets(hits, contents)
    assert got.columns == ["id", "blob_sha", "line", "snippet"]
    assert {r.id: r.snippet for r in got.collect()} == {0: "x", 1: "", 2: "y", 3: "", 4: None, 5: None, 6: None, 7: None, 8: None, 9: None, 10: ""}
    join = next(x for x in plan_of(got).splitlines() if "Join" in x)
    assert "_line" in join and "content" not in join


def test_lines_are_enclosed_once_each(spark):
    sites = spark.createDataFrame([(i, "b", i % 3 + 1) for i in range(30)] + [(30, "b", None), (31, "x", 1)], "id long, blob_sha string, line long")
    symbols = spark.createDataFrame([(1, "b", 1, 9), (2, "b", 2, 3), (3, "b", 3, 4), (4, "b", 3, 4)], "id long, blob_sha string, line_start long, line_end long")
    found = enclosing.enclosing_by_line(sites, symbols)
    assert {r.id: r.enclosing for r in found.collect()} == {i: {0: 1, 1: 2, 2: 3}[i % 3] for i in range(30)} | {30: None, 31: None}
    assert not re.search(r"keys=\[id#\d+L?\]", plan_of(found))  # nothing is grouped by site


def test_many_keys_are_joined_instead(spark, monkeypatch):
    from sparkloom.plans import layouts

    names = ("q7_references_strict", "q8_references_outgoing", "q6_references_bare", "q13_find_callees")
    rows = lambda: [sorted(map(str, queries.queries()[n](spark, SF).collect())) for n in names]
    few = rows()
    monkeypatch.setattr(layouts, "FEW_KEYS", 0)
    monkeypatch.setattr(lookup, "FEW_ROWS", 0)
    assert rows() == few and any(few)
    lookup.release(spark)


def test_postings_answer_as_the_texts_do(spark):
    rows = [(1, "red_red_widget", "a::red", "a red, red widget"), (2, "Widget", None, "Red? WIDGETS red"), (3, "x", "red.widget", None), (4, None, None, None), (5, "été_9", "9", "widget red red widget")]
    s = spark.createDataFrame(rows, "id long, name string, qualified string, doc string")
    words = fts.postings(s, ["name", "qualified", "doc"])
    for q in ("red", "wid*", '"red widget"', '"red red"', '"red wid"*', "red widget", '"red red widget" x', '"widget red" 9', "ÉTÉ", "none", '"a red" wid*'):
        want = [r.id for r in s.filter(fts.matches(q, [F.col(c) for c in ("name", "qualified", "doc")])).orderBy("id").collect()]
        assert [r.id for r in fts.search(words, q).orderBy("id").collect()] == want, q


def test_filters_reach_the_scan(spark):
    plan = queries.queries()["q14_outline_file"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan
    scan = Facts(spark, SF).part.filter("p_size = 3").select("p_name")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*EqualTo\(p_size,3\)", scan) and "p_brand" not in scan


SMALL = list(queries.SQL)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in RAW:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SMALL)
def test_query_equals_its_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda data, names: sorted(str([r[names.index(c)] for c in sorted(names)]) for r in data)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), columns)


def test_generation_states():
    s = generations.State()
    for kind, at in (("dirty", 5), ("force", 7)):
        assert generations.step(s, kind, at)
    assert (s.desired, s.forced, s.dirty_since) == (2, 2, 5)
    assert not generations.step(s, "start", 8, 3) and generations.step(s, "start", 8, 1) and not generations.step(s, "start", 9)
    assert generations.step(s, "success", 10) and (s.applied, s.dirty_since) == (1, 5)
    assert generations.step(s, "start", 11) and generations.step(s, "failure", 12, error="x" * 999)
    assert s.failures == 1 and s.next_retry == 12 + generations.BASE_NS and len(s.last_error) == generations.MAX_ERROR
    generations.step(s, "immediate", 13)
    assert s.next_retry is None and generations.step(s, "start", 14) and generations.step(s, "recover", 15) and s.attempt is None


def test_events(spark):
    rows = [("src/a.py", "modify"), ("src/a.py", "remove"), (".git/HEAD", "modify"), (".git/objects/x", "create"), ("a/.gitignore", "modify"), ("node_modules/x", "create"), ("", "overflow")]
    got = [r.k for r in spark.createDataFrame(rows, "p string, c string").select(coalesce.classify(F.col("p"), F.col("c")).alias("k")).collect()]
    assert got == ["file_touched", "file_deleted", "git", None, "rescan", None, "rescan"]
    events = spark.createDataFrame([("r", 1, "a", "file_touched", 1, 1), ("r", 1, "a", "file_deleted", 2, 2), ("s", 1, "a", "file_touched", 1, 1), ("s", 1, None, "rescan", 2, 2)], "repo string, w int, path string, kind string, at long, seq long")
    assert {(r.repo, r.kind, r.path) for r in coalesce.collapse(events, ["repo", "w"]).collect()} == {("r", "file_deleted", "a"), ("s", "rescan", None)}
    ticks = spark.createDataFrame([("r", at, at) for at in (0, 100, 499, 500, 1200)] + [("q", 7, 1)], "repo string, at long, seq long")
    assert sorted(tuple(r) for r in coalesce.windows_batch(ticks, 500).collect()) == [("q", 7, 1), ("r", 0, 3), ("r", 500, 1), ("r", 1200, 1)]


def test_rescans_have_the_reason_of_their_first_event(spark):
    rows = [("a", "rename"), ("a", "create_dir"), ("x/.git", "create"), (".git/HEAD", "remove"), (".git/packed-refs", "remove"), (".git/worktrees/w/index", "modify"), (".git/worktrees/w/HEAD", "modify"),
            (".git/refs/heads/x", "remove"), (".git/refs/heads", "modify"), ("x/.gitignore", "remove"), (".git", "create_dir")]
    frame = spark.createDataFrame([("r", 1, k, k, *x) for k, x in enumerate(rows)], "repo string, w int, at int, seq int, path string, change string")
    frame = frame.select("*", coalesce.classify(F.col("path"), F.col("change")).alias("kind"), coalesce.rescan_reason(F.col("path"), F.col("change")).alias("reason"))
    got = [(r.kind, r.reason) for r in frame.orderBy("at").collect()]
    topology = ("rescan", "directory_topology_changed")
    assert got == [topology, topology, topology, (None, None), (None, None), (None, None), ("git", None), ("git", None), (None, None), ("rescan", "ignore_rules_changed"), (None, None)]
    late = frame.filter("at > 5").select("repo", "w", "path", "kind", "at", "seq", "reason")
    assert [(r.kind, r.reason) for r in coalesce.collapse(late, ["repo", "w"]).collect()] == [("rescan", "ignore_rules_changed")]


def test_states_of_snapshots_without_files_symbols_or_analyzers(spark):
    class Small:
        repo_anchors = spark.createDataFrame([("h", "HEAD", 1), ("h", "branch/a", 1), ("h", "tag/t", 2), ("g", "HEAD", 3), ("e", "HEAD", 4)], "repo_hash string, anchor_name string, manifest_id long")
        manifest_entries = spark.createDataFrame([(1, "a", "b1"), (2, "a", "b2"), (3, "a", "b3")], "manifest_id long, path string, blob_sha string")
        blobs = spark.createDataFrame([("b1", "p", None), ("b2", "p", None), ("b3", "q", None)], "blob_sha string, parser_id string, analyzer_id string")
        symbols = spark.createDataFrame([("b1",)], "blob_sha string")
        analyzers = spark.createDataFrame([("p", None)], "parser_id string, analyzer_id string")
        runs = spark.createDataFrame([(2, 5, "running"), (3, 6, "failed")], "manifest_id long, job_id long, status string")

    assert {(r.repo_hash, r.manifest_id): r.status for r in repos.snapshot_states(Small).collect()} == {("h", 1): "ready", ("h", 2): "stale", ("g", 3): "no_analyzer", ("e", 4): "empty"}
    aliases = spark.createDataFrame([(x, x) for x in "hgez"], "alias string, repo_hash string")
    repositories = spark.createDataFrame([(x, "/" + x, 0, m) for x, m in zip("hgez", (1, 3, 4, 9))], "repo_hash string, root_path string, registered_at_ns long, manifest_id long")
    got = {r.alias: (r.snapshot_count, r.current_file_count, r.status) for r in repos.list_repos(aliases, repositories, Small).collect()}
    assert got == {"h": (2, 1, "indexing"), "g": (1, 1, "partial"), "e": (1, 0, "ready"), "z": (0, 0, "error")}


@pytest.mark.parametrize(
    "text, language",
    [
        (b"@class Foo;", "objc"), (b"  @end", "objc"), (b"@endless x", "c"), (b"#import <a.h>", "objc"), (b"// #import <a.h>", "c"), (b"# import", "c"), (b"@implementation", "objc"),
        (b"void f() noexcept;", "cpp"), (b"int *p = nullptr;", "cpp"), (b"#include <vector>", "cpp"), (b"#include <vectors.h>", "c"), (b"bool operator==(x)", "cpp"), (b"concept C = 1;", "cpp"), (b"f() requires x", "cpp"),
        (b"protected :", "cpp"), (b"int public;", "c"), (b"a::b", "cpp"), (b'char *s = "a::b class";', "c"), (b"char c = ':';", "c"), (b"/* class x */ int y;", "c"), (b"int classy;", "c"), (b"virtual_x", "c"),
    ],
)
def test_headers(text, language):
    assert extract.header_language(text) == language


def test_streams(spark, tmp_path):
    events = [("r", 1, 1, "dirty", None, None), ("r", 2, 2, "force", None, None), ("r", 3, 3, "start", None, None), ("r", 4, 4, "success", None, None)]
    schema = "repo string, at long, seq long, kind string, generation long, error string"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = generations.stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("states").outputMode("update").start()
    try:
        q.processAllAvailable()
        row = spark.table("states").first()
        assert (row.desired, row.applied, row.forced, row.attempt) == (2, 2, 2, None)
    finally:
        q.stop()


def test_bodies_of_every_blob(spark):
    f = Facts(spark, SF)
    content = {r.blob_sha: r.content.encode() for r in queries.contents(f).collect()}
    want = {(s.id, s.qualified, content[s.blob_sha][s.byte_start : s.byte_end].decode("utf-8", "replace")) for s in f.symbols.collect() if s.blob_sha in content}
    got = [tuple(r) for r in queries.queries()["q17_symbol_texts"](spark, SF).select("id", "qualified", "body").collect()]
    assert set(got) == want and len(got) == queries.queries()["q17_symbol_bodies"](spark, SF).count()
    assert any(not body.isascii() for _, _, body in want)
