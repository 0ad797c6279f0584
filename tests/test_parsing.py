"""Extractors, ignore rules, linearisation and text functions on small inputs."""

import random
import subprocess
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import fts, text
from sparkloom.operators import extract, lookup, repos, resolution
from sparkloom.plans import linearize as lin
from sparkloom.plans import register, snapshots
from sparkloom.sources import worktree
from sparkloom.sources.ignore import IgnoreRules

PYTHON = b'''from animal import Animal
from util import helper as aliased
import os.path

class Dog(Animal):
    """A dog."""

    def speak(self, n: int) -> list[str]:
        def inner():
            return n
        return aliased(self.bark(inner()))

    def _hidden(self): pass

def test_dog():
    Dog().speak(1)
'''


def by(rows, fact):
    return [r for r in rows if r["fact"] == fact]


def test_python_facts():
    rows = extract.facts_of("python", PYTHON)
    symbols = {r["qualified"]: r for r in by(rows, "symbol")}
    assert [(s["kind"], s["scope"]) for s in symbols.values()] == [("class", "top_level"), ("method", "top_level"), ("function", "nested"), ("method", "top_level"), ("test", "top_level")]
    assert symbols["Dog"]["doc"] == "A dog." and symbols["Dog._hidden"]["visibility"] == "crate" and symbols["Dog.speak"]["parent"] == "Dog"
    assert PYTHON[symbols["Dog"]["byte_start"] :].startswith(b"class Dog")
    assert [(r["target"], r["enclosing"]) for r in by(rows, "ref") if r["kind"] == "call"] == [("aliased", "Dog.speak"), ("bark", "Dog.speak"), ("inner", "Dog.speak"), ("speak", "test_dog"), ("Dog", "test_dog")]
    assert {(r["target"], r["role"]) for r in by(rows, "ref") if r["kind"] == "type"} == {("int", "param"), ("list", "generic_arg"), ("str", "generic_arg")}
    assert [(r["target"], r.get("name"), r["alias"]) for r in by(rows, "import")] == [("animal", "Animal", None), ("util", "helper", "aliased"), ("os.path", None, None)]
    assert [(r["qualified"], r["target_qualified"], r["kind"]) for r in by(rows, "implementation")] == [("Dog", "Animal", "inherit")]
    assert extract.facts_of("python", b"def (")[0]["fact"] == "error"


def test_markdown_sections():
    rows = extract.facts_of("markdown", b"# A\ntext\n\n## B ##\n```\n# no\n```\nTitle\n-----\n### C\n# D\n")
    assert [r["qualified"] for r in rows] == ["A", "A > B", "A > Title", "A > Title > C", "D"]


@pytest.mark.parametrize(
    ("language", "source", "symbols", "bases"),
    [
        ("rust", b"pub struct Dog;\nimpl Speak for Dog {\n    pub fn speak(&self) {\n        helper(1);\n    }\n}\nfn main() {}\n", ["Dog", "Dog", "Dog::speak", "main"], [("Dog", "Speak", "trait")]),
        ("java", b"package a;\nimport a.b.C;\npublic class Dog extends Animal implements Loud, Big {\n  void speak() {\n    bark();\n  }\n}\n", ["Dog", "Dog.speak"], [("Dog", "Animal", "inherit"), ("Dog", "Loud", "implement"), ("Dog", "Big", "implement")]),
        ("typescript", b"import { A } from './a';\nexport class Dog extends Animal {\n  speak() {\n    this.bark();\n  }\n}\nexport const run = (x) => x;\n", ["Dog", "Dog.speak", "run"], [("Dog", "Animal", "inherit")]),
        ("go", b'import "fmt"\ntype Dog struct {\n}\nfunc (d *Dog) Speak() {\n\tfmt.Println()\n}\n', ["Dog", "Dog.Speak"], []),
        ("csharp", b"using System;\nnamespace Zoo\n{\n  public class Dog : Animal\n  {\n    public void Speak()\n    {\n      Bark();\n    }\n  }\n}\n", ["Zoo", "Zoo.Dog", "Zoo.Dog.Speak"], [("Zoo.Dog", "Animal", "inherit")]),
        ("kotlin", b"import a.B\nclass Dog : Animal() {\n  fun speak() {\n    bark()\n  }\n}\n", ["Dog", "Dog.speak"], [("Dog", "Animal", "inherit")]),
        ("swift", b"import Foundation\nstruct Dog: Animal {\n  func speak() {\n    bark()\n  }\n}\n", ["Dog", "Dog.speak"], [("Dog", "Animal", "inherit")]),
        ("php", b"<?php\nuse A\\B;\nclass Dog extends Animal {\n  public function speak() {\n    bark();\n  }\n}\n", ["Dog", "Dog::speak"], [("Dog", "Animal", "inherit")]),
        ("cpp", b"#include <x>\nnamespace zoo {\nclass Dog : public Animal {\n  int speak() {\n    return bark();\n  }\n};\n}\n", ["zoo", "zoo::Dog", "zoo::Dog::speak"], [("zoo::Dog", "Animal", "inherit")]),
        ("c", b"#include <x.h>\nint speak(int n) {\n  return bark(n);\n}\n", ["speak"], []),
        ("ruby", b"require 'x'\nmodule Zoo\n  class Dog < Animal\n    include Loud\n    def speak\n      bark\n    end\n  end\nend\n", ["Zoo", "Zoo::Dog", "Zoo::Dog::speak"], [("Zoo::Dog", "Animal", "inherit"), ("Zoo::Dog", "Loud", "include")]),
    ],
)
def test_other_languages(language, source, symbols, bases):
    rows = extract.facts_of(language, source)
    assert [r["qualified"] for r in by(rows, "symbol")] == symbols
    assert [(r["qualified"], r["target"], r["kind"]) for r in by(rows, "implementation")] == bases
    if language not in ("rust",):
        assert by(rows, "import")
    if language != "ruby":
        assert any(r["target"] in ("bark", "Bark", "helper", "Println") for r in by(rows, "ref"))


def test_dispatch():
    assert extract.dispatch("a/b.py", b"") == "python" and extract.dispatch("x", b"#!/usr/bin/env ruby\n") == "ruby"
    assert extract.dispatch("a.h", b"// class\nint f(void);") == "c" and extract.dispatch("a.h", b"namespace a {}") == "cpp"
    assert extract.dispatch("a.h", b"@interface A\n@end") == "objc" and extract.dispatch("a.txt", b"x") is None


def test_ignore_rules():
    rules = IgnoreRules({"": "*.log\n!keep.log\n/build/\ndoc/**/x\n# no\n", "sub": "!a.log\nlocal\n"}, "secret\n", ["vendor/own"])
    yes = ["a.log", "d/b.log", "build/x", "doc/x", "doc/a/b/x", "secret", "sub/local", "sub/local/deep", "vendor/own/f", ".git/HEAD", "a/node_modules/b", "target/x"]
    no = ["keep.log", "sub/a.log", "src/build.py", "a/build/x", "vendor/own2/f", "local", ".gitignore", "node_modules.py"]
    assert [p for p in yes if not rules.ignored(p)] == [] and [p for p in no if rules.ignored(p)] == []


def test_worktree_git_and_reuse(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src" / "dog.py").write_bytes(PYTHON)
    (root / "src" / "copy.py").write_bytes(PYTHON)
    (root / "empty.md").write_bytes(b"")
    (root / "x.log").write_bytes(b"no")
    (root / ".gitignore").write_text("*.log\n")
    files = worktree.worktree(spark, str(root)).cache()
    got = {r.path: r.blob_sha for r in files.collect()}
    assert set(got) == {"src/dog.py", "src/copy.py", "empty.md", ".gitignore"}
    assert got["empty.md"] == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391" == text.git_sha_of(b"")
    assert worktree.verified(files).count() == 4
    facts = extract.extract(files)
    assert facts.filter("fact = 'symbol'").count() == 5  # equal content is parsed once
    worktree.publish({"files": files.drop("content")}, str(tmp_path / "store"), "s1")
    assert worktree.published(spark, str(tmp_path / "store"), "s1")["files"].count() == 4
    with pytest.raises(LookupError):
        worktree.published(spark, str(tmp_path / "store"), "s2")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "x")
    assert {r.path: r.blob_sha for r in worktree.git_tree(spark, str(root)).collect()} == got
    assert dict(worktree.read_blobs(str(root), [got["src/dog.py"]]))[got["src/dog.py"]] == PYTHON
    with pytest.raises(ValueError):
        list(worktree.read_blobs(str(root), ["HEAD"]))


def test_a_worktree_is_registered_and_asked(spark, tmp_path):
    root, store = tmp_path / "repo", register.Store(spark, f"file://{tmp_path}/store")
    (root / "src").mkdir(parents=True)
    (root / "src" / "dog.py").write_bytes(PYTHON)
    (root / "zoo.php").write_bytes(b"<?php\nclass Zoo extends Place {\n  use Loud;\n}\n")
    (root / "bad.py").write_bytes(b"def (")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("add", "-A")
    run("commit", "-qm", "x")
    (root / "src" / "cat.rs").write_bytes(b"pub const N: u8 = 1;\nstatic S: u8 = 2;\ntype T = u8;\npub struct Cat;\nimpl Loud for Cat {\n}\n")
    first = register.register_repo(store, str(root), 10)
    assert (first.committed_manifest, first.tentative_manifest, first.blobs_parsed, first.reused) == (1, 2, 4, False)
    at = lambda name: snapshots.resolve(store.anchors, name)
    assert (at("HEAD"), at("branch/main"), at("tentative/1")) == (1, 1, 2)
    assert [(r.path, r.kind, r.doc) for r in lookup.find_symbols(store, 2, "Dog").collect()] == [("src/dog.py", "class", "A dog.")]
    assert {r.qualified for r in lookup.get_outline(store, 2, "src/cat.rs").collect()} == {"N", "S", "T", "Cat"}
    assert lookup.get_outline(store, 1, "src/cat.rs").count() == 0  # the commit does not have it
    bases = {(r.type_qualified, r.interface_qualified, r.kind, r.kind_source) for name in ("Zoo", "Cat") for r in lookup.find_supertypes(store, 2, name).collect()}
    assert bases == {("Zoo", "Place", "inherit", "tier2-direct-php"), ("Zoo", "Loud", "mixin", "tier2-direct-php"), ("Cat", "Loud", "implement", "tier2-direct-rust")}
    callers = lookup.find_callers(store, 2, "bark").collect()
    assert [(r.enclosing, r.path) for r in callers] == [("Dog.speak", "src/dog.py")]
    assert [r.to_module for r in lookup.find_imports(store, 2, "src/dog.py").collect()] == ["animal", "util", "os.path"]
    assert store.errors.count() == 1
    again = register.register_repo(store, str(root), 20, generation=7)
    assert (again.tentative_manifest, again.blobs_parsed, again.reused) == (2, 0, True)
    assert store.anchors.filter("anchor_name = 'tentative/1'").first().reconcile_generation == 7
    (root / "src" / "dog.py").write_bytes(PYTHON + b"\ndef more(): pass\n")
    third = register.register_repo(register.Store(spark, f"file://{tmp_path}/store"), str(root), 30)
    assert (third.committed_manifest, third.tentative_manifest, third.blobs_parsed) == (1, 3, 1)
    store = register.Store(spark, f"file://{tmp_path}/store")
    assert lookup.find_symbols(store, 3, "more").count() == 1 and lookup.find_symbols(store, 1, "more").count() == 0
    assert register.register_repo(store, str(root), 40, force=True).tentative_manifest == 4
    register.remove_anchors(store, ["tentative/1"])
    assert {r.anchor_name for r in store.anchors.collect()} == {"HEAD", "branch/main"} and store.symbols.filter("name = 'more'").count() == 0


def test_a_store_grows_with_its_changes_and_is_compacted(spark, tmp_path, monkeypatch):
    from sparkloom.functions.text import git_sha

    def files(rows):
        df = spark.createDataFrame([(p, bytearray(c.encode())) for p, c in rows], "path string, content binary")
        return df.withColumn("blob_sha", git_sha(F.col("content")))

    def size(path):
        return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))

    root = f"file://{tmp_path}/store"
    store = register.Store(spark, root)
    rows = {f"d/f{k}.py": f"def widget_{k}(): return {k}\n" for k in range(200)}
    register.register_files(store, files(rows.items()), "tentative/1", 1)
    whole, sizes = size(tmp_path / "store" / "symbols" / "1") + size(tmp_path / "store" / "blobs" / "1"), []
    for n in range(2, 5):
        rows[f"d/f{n}.py"] = f"def widget_{n}(): return changed\n"
        done = register.register_files(store, files(rows.items()), "tentative/1", n)
        assert (done.blobs_parsed, done.reused) == (1, False)
        sizes.append(size(tmp_path / "store" / "symbols" / str(n)) + size(tmp_path / "store" / "blobs" / str(n)))
    assert max(sizes) < whole and not (tmp_path / "store" / "symbols" / "9").exists()
    again = register.register_files(store, files(reversed(list(rows.items()))), "tentative/1", 9)
    assert again.reused and again.blobs_parsed == 0
    forced = register.register_files(store, files(list(rows.items())[:150]), "tentative/2", 10)

    def seen(s):
        manifest = snapshots.resolve(s.anchors, "tentative/1")
        words = sorted((r.name, r.path) for r in lookup.find_symbols(s, manifest, "widget 3", fuzzy=True, limit=1000).collect())
        return words, sorted(r.name for r in lookup.find_symbols(s, manifest, "widget_7").collect()), s.symbols.count(), s.blobs.count(), s.manifest_entries.count()

    before = seen(store)
    assert before[0] == [("widget_3", "d/f3.py")] and before[1] == ["widget_7"] and before[4] == 4 * 200 + 150
    n = store.compact()
    assert all(len(p) == 1 for p in store.live["tables"].values()) and n == forced.generation + 1
    assert seen(store) == before and seen(register.Store(spark, root)) == before
    assert store.vacuum() > 10 and seen(register.Store(spark, root)) == before
    # facts that are newer than the layouts are seen; what is taken back is not
    rows["d/new.py"] = "def widget_new(): pass\n"
    register.register_files(store, files(rows.items()), "tentative/3", 11)
    manifest = snapshots.resolve(store.anchors, "tentative/3")
    assert [r.path for r in lookup.find_symbols(store, manifest, "widget new", fuzzy=True).collect()] == ["d/new.py"]
    assert [r.path for r in lookup.find_symbols(store, manifest, "widget_new").collect()] == ["d/new.py"]
    register.remove_anchors(store, ["tentative/3"])
    assert store.symbols.filter("name = 'widget_new'").count() == 0 and store.blobs.count() == before[3] - 3  # and the contents of older manifests
    again = register.register_files(store, files(rows.items()), "tentative/3", 12)
    assert again.blobs_parsed >= 1 and store.symbols.filter("name = 'widget_new'").count() == 1
    monkeypatch.setattr(register, "COMPACT_AFTER", 1)
    rows["d/last.py"] = "def last(): pass\n"
    register.register_files(store, files(rows.items()), "tentative/3", 13)
    assert len(store.live["tables"]["symbols"]) == 1 and store.symbols.filter("name = 'widget_new'").count() == 1


def test_a_registration_parses_contents_once_and_in_small_batches(spark, tmp_path, monkeypatch):
    from sparkloom.functions.text import git_sha

    inner, schema = extract.extract_units, "blob_sha string, parser_id string, content binary"
    (tmp_path / "seen").mkdir()

    def counted(units):
        def tally(batches):
            for b in batches:
                (tmp_path / "seen" / f"{uuid.uuid4().hex}").write_text(f"{len(b)} {b['content'].str.len().sum()}")
                yield b

        return inner(units.select("blob_sha", "parser_id", "content").mapInPandas(tally, schema))

    monkeypatch.setattr(extract, "extract_units", counted)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    content = F.when(F.col("id") < 6000, F.concat(F.lit("def f"), F.col("id"), F.lit("(): pass\n"))).otherwise(F.concat(F.lit("# "), F.col("id"), F.repeat(F.lit("\nword"), 100_000)))
    files = spark.range(0, 6040, 1, 1).select(F.concat(F.col("id"), F.when(F.col("id") < 6000, ".py").otherwise(".md")).alias("path"), F.encode(content, "UTF-8").alias("content"))
    store = register.Store(spark, f"file://{tmp_path}/store")
    assert register.register_files(store, files.withColumn("blob_sha", git_sha(F.col("content"))), "tentative/1", 1).blobs_parsed == 6040
    seen = [tuple(map(int, f.read_text().split())) for f in (tmp_path / "seen").iterdir()]
    assert sum(n for n, _ in seen) == 6040 and max(n for n, _ in seen) <= 1000 and max(size for _, size in seen) < 8 << 20
    assert store.symbols.count() == 6040 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_dispatch_sends_python_what_it_needs(spark):
    files = [
        ("a/b.py", b"#!/usr/bin/ruby\n"), ("dir.py/run", b"#!/usr/bin/env python\nx"), ("x.h", b"@interface A\n"), ("x.h", b"int a;\n" * 9000 + b"class A"), ("x.h", b"int a;"), (".py", b"x"),
        ("a.", b"#!/bin/node"), ("a.txt", b"plain"), ("a.txt", b"#!/usr/bin/php"), ("b.PY", b""), ("h", b"class A"), ("c.tar.md", b""), ("x.py\n", b""),
    ]
    df = spark.createDataFrame([(k, p, bytearray(c)) for k, (p, c) in enumerate(files)], "k int, path string, content binary")
    known, head = extract.head_of(F.col("path"), F.col("content"))
    got = {r.k: r for r in df.select("k", extract.dispatched(F.col("path"), F.col("content")).alias("language"), known.alias("known"), F.octet_length(head).alias("sent")).collect()}
    assert [got[k].language for k in range(len(files))] == [extract.dispatch(p, c) for p, c in files]
    assert all(r.sent is None if r.known else r.sent <= (65536 if files[k][0].endswith(".h") else 256) for k, r in got.items())


def test_bases_constructors_and_fields():
    facts = lambda language, source: extract.facts_of(language, source)
    cpp = facts("cpp", b"class A : public B, private C {\n};\nstruct D : E {\n};\n")
    assert [(r["target"], r["role"]) for r in by(cpp, "implementation")] == [("B", "public_base"), ("C", "private_base"), ("E", "public_base")]
    java = facts("java", b"class A {\n  private int n = 1;\n  A(int n) {\n    run(n);\n  }\n}\n")
    assert [(r["qualified"], r["kind"]) for r in by(java, "symbol")] == [("A", "class"), ("A.n", "field"), ("A.A", "constructor")]
    assert [(r["target"], r["enclosing"]) for r in by(java, "ref")] == [("run", "A.A")]
    go = facts("go", b"const Most = 3\nvar seen int\ntype ID = string\n")
    assert [(r["qualified"], r["kind"]) for r in by(go, "symbol")] == [("Most", "constant"), ("seen", "variable"), ("ID", "type_alias")]


def test_linear_orders():
    diamond = {"D": ["B", "C"], "B": ["A"], "C": ["A"], "A": []}
    assert lin.c3("D", diamond) == ["D", "B", "C", "A"] and lin.breadth_first("D", diamond) == ["D", "B", "C", "A"]
    assert lin.python_order("X", {"X": ["A", "B"], "A": ["B"], "B": []}) == ["X", "A", "B"]
    bad = {"X": ["A", "B"], "A": ["O", "P"], "B": ["P", "O"]}
    assert lin.c3("X", bad) is None and lin.python_order("X", bad) == ["X", "A", "O", "P", "B"]
    loop = {"A": ["B"], "B": ["A"]}
    assert lin.c3("A", loop) is None and lin.python_order("A", loop) == ["A", "B"]
    kinds = {"Dog": {"inherit": ["Animal"], "include": ["M1", "M2"], "prepend": ["P"], "extend": ["E"]}, "Animal": {"include": ["M0"]}}
    assert lin.ruby_order("Dog", kinds) == ["P", "Dog", "M2", "M1", "Animal", "M0"]
    assert lin.ruby_order("Dog", kinds, singleton=True) == ["Dog", "E", "Animal"]
    php = {"S": {"inherit": ["B"], "mixin": ["T"], "implement": ["I"]}, "B": {"mixin": ["U"]}, "I": {"inherit": ["J"]}}
    assert lin.php_order("S", php) == ["S", "T", "B", "U", "I", "J"]


def plain_c3(name, bases):
    """Python itself makes the class."""
    made = {}

    def make(n):
        if n not in made:
            made[n] = type(n, tuple(make(b) for b in bases.get(n, [])) or (object,), {})
        return made[n]

    try:
        return [c.__name__ for c in make(name).__mro__ if c is not object]
    except TypeError:
        return None


def test_orders_of_random_hierarchies_are_those_of_python(spark):
    rnd = random.Random(5)
    edges, want = [], {}
    for w in range(12):
        names = [f"K{k}" for k in range(14)]
        bases = {n: rnd.sample(names[:k], rnd.randint(0, min(3, k))) for k, n in enumerate(names)}
        edges += [(str(w), n, b, "inherit", i) for n, bs in bases.items() for i, b in enumerate(bs)]
        want |= {(str(w), n): plain_c3(n, bases) or lin.depth_first(n, bases) for n in names}
    assert sum(lin.c3(n, {c: [b for x, c2, b, _, _ in edges if x == "0" and c2 == c] for c in names}) is None for n in names) < 14
    got = {}
    for r in lin.linearized(spark.createDataFrame(edges, "workspace string, class string, base string, kind string, ordinal int").repartition(5)).orderBy("position").collect():
        got.setdefault((r.workspace, r["class"]), []).append(r.ancestor)
    assert got == {k: v for k, v in want.items() if k in got} and len(got) > 100


def test_long_chains_and_loops_end(spark):
    assert lin.height("A", {"A": ["B"], "B": ["A"]}) == float("inf") and lin.height("A", {"A": ["B", "C"], "B": ["C"]}) == 2
    wide = {f"L{k}": [f"L{k + 1}", f"M{k + 1}"] for k in range(40)} | {f"M{k}": [f"L{k + 1}", f"M{k + 1}"] for k in range(1, 40)}
    assert len(lin.python_order("L0", wide)) == 81  # each class once, whatever the number of ways
    edges = spark.createDataFrame([("w", f"c{k}", f"c{(k + 1) % 90}", "inherit", 0) for k in range(90)], "workspace string, class string, base string, kind string, ordinal int")
    assert lin.linearized(edges).filter("class = 'c5'").count() == 90


def test_receivers(spark):
    calls = spark.createDataFrame([(1, "w", "self", "B", "m"), (2, "w", "super()", "B", "m"), (3, "w", "Alias", None, "m"), (4, "w", "Two", None, "m"), (5, "w", "x", "B", "m"), (6, "w", None, "B", "m")], "id int, workspace string, receiver string, enclosing_class string, method string")
    names = spark.createDataFrame([("w", "Alias", "A"), ("w", "Two", "A"), ("w", "Two", "B"), ("v", "x", "A")], "workspace string, name string, class string")
    edges = spark.createDataFrame([("w", "B", "A", "inherit", 0)], "workspace string, class string, base string, kind string, ordinal int")
    methods = spark.createDataFrame([("w", "A", "m"), ("w", "B", "m")], "workspace string, class string, method string")
    got = {r.id: r.owner for r in lin.dispatched(lin.receiver_classes(calls, names), lin.linearized(edges), methods).collect()}
    assert got == {1: "B", 2: "A", 3: "A", 4: None, 5: None, 6: None}


def test_chains_and_dispatch(spark):
    edges = spark.createDataFrame([("w", "Dog", "Animal", "inherit", 0), ("w", "Puppy", "Dog", "inherit", 0)], "workspace string, class string, base string, kind string, ordinal int")
    chains = lin.linearized(edges)
    assert [r.ancestor for r in chains.filter("class = 'Puppy'").orderBy("position").collect()] == ["Puppy", "Dog", "Animal"]
    calls = spark.createDataFrame([(1, "w", "Puppy", "speak"), (2, "w", "Puppy", "fly")], "id int, workspace string, class string, method string")
    methods = spark.createDataFrame([("w", "Animal", "speak"), ("w", "Dog", "speak")], "workspace string, class string, method string")
    assert {r.id: r.owner for r in lin.dispatched(calls, chains, methods).collect()} == {1: "Dog", 2: None}


def test_imports(spark):
    modules = spark.createDataFrame([("pkg", "pkg/__init__.py", True), ("pkg.a", "pkg/a.py", False), ("pkg.sub.b", "pkg/sub/b.py", False), ("util", "util.py", False)], "module string, path string, is_package boolean")
    imports = spark.createDataFrame([(1, "pkg.a", "util", "helper"), (2, "pkg.sub.b", "..a", "x"), (3, "pkg.a", ".", "a"), (4, "pkg", ".a", None), (5, "pkg.a", "os", None)], "id int, module string, target string, name string")
    assert {r.id: r.target_path for r in lin.python_imports(imports, modules).collect()} == {1: "util.py", 2: "pkg/a.py", 3: "pkg/a.py", 4: "pkg/a.py", 5: None}
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.js",), ("c.js",)], "path string")
    specs = spark.createDataFrame([(1, "src/x.ts", "./a"), (2, "src/x.ts", "./b"), (3, "src/x.ts", "../c.js"), (4, "src/x.ts", "react"), (5, "src/x.ts", "./none")], "id int, path string, specifier string")
    assert {r.id: r.target_path for r in lin.relative_specifiers(specs, files).collect()} == {1: "src/a.ts", 2: "src/b/index.js", 3: "c.js", 4: None, 5: None}


def test_imports_of_a_workspace(spark):
    from sparkloom.plans.imports import resolve_imports

    files = [("src/shop/__init__.py", "src.shop", True), ("src/shop/app.py", "src.shop.app", False), ("src/shop/sub/x.py", "src.shop.sub.x", False), ("zoo/app.py", "zoo.app", False), ("run.py", "run", False), ("__init__.py", None, True)]
    symbols = [("src/shop/app.py", "src.shop.app.Shop", True, 9), ("src/shop/app.py", "src.shop.app.Shop.run", False, 12), ("zoo/app.py", "zoo.app.Shop", True, 1), ("zoo/app.py", "zoo.app.keep", False, 2)]
    imports = [
        (1, "run.py", "shop", None), (2, "run.py", "shop.app", "Shop"), (3, "run.py", "app", "Shop"), (4, "run.py", "zoo.app", "Shop"), (5, "src/shop/sub/x.py", "..app", "Shop"), (6, "src/shop/__init__.py", ".", "app"),
        (7, "run.py", "os", None), (8, "run.py", "elsewhere", "keep"), (9, "run.py", "zoo.app", "gone"), (10, "run.py", "elsewhere", "gone"), (11, "run.py", "zoo.app", "*"), (12, "run.py", "elsewhere", "*"),
        (13, "run.py", "...x", "y"), (14, "__init__.py", ".", "run"), (15, "src/shop/sub/x.py", ".", "x"), (16, "run.py", ".", "run"), (17, "none.py", ".a", "keep"),
    ]
    got = resolve_imports(
        spark.createDataFrame(imports, "id int, path string, target string, name string"),
        spark.createDataFrame(files, "path string, module string, is_package boolean"),
        spark.createDataFrame(symbols, "path string, qualified string, is_class boolean, place int"),
    )
    assert {r.id: (r.target_path, r.target_qualified) for r in got.collect()} == {
        1: ("src/shop/__init__.py", "shop"), 2: ("src/shop/app.py", "src.shop.app.Shop"), 3: ("src/shop/app.py", "src.shop.app.Shop"), 4: ("zoo/app.py", "zoo.app.Shop"),
        5: ("src/shop/app.py", "src.shop.app.Shop"), 6: ("src/shop/app.py", "src.shop.app"), 7: (None, None), 8: ("zoo/app.py", "zoo.app.keep"), 9: ("zoo/app.py", "zoo.app"), 10: (None, None),
        11: ("zoo/app.py", "zoo.app"), 12: (None, "elsewhere"), 13: (None, None), 14: (None, None), 15: ("src/shop/sub/x.py", "src.shop.sub.x"), 16: ("src/shop/app.py", "src.shop.app.Shop.run"), 17: (None, None),
    }


def test_exports_are_followed_to_their_origin(spark):
    from sparkloom.plans.imports import flattened_exports, resolve_exports

    passed = [(f"c{k}.js", "a", f"c{k + 1}.js", "a") for k in range(12)] + [("p.js", "a", "q.js", "b"), ("q.js", "b", "p.js", "a"), ("s.js", "a", "s.js", "a"), ("m.js", "M", "n.js", "N"), ("n.js", "N", "o.js", "default")]
    frame = spark.createDataFrame(passed, "path string, name string, to_path string, to_name string")
    got = {(r.path, r.name): (r.origin_path, r.origin_name, r.dropped) for r in flattened_exports(frame).collect()}
    ends = {(f"c{k}.js", "a"): ("c12.js", "a", False) if 12 - k <= 8 else (None, None, True) for k in range(12)}
    assert got == ends | {("p.js", "a"): (None, None, True), ("q.js", "b"): (None, None, True), ("s.js", "a"): (None, None, True), ("m.js", "M"): ("o.js", "default", False), ("n.js", "N"): ("o.js", "default", False)}
    imports = [(1, "./m", "m.js", "M"), (2, "./c5", "c5.js", "a"), (3, "./c0", "c0.js", "a"), (4, "./m", "m.js", None), (5, "react", None, "useX"), (6, "react", None, None), (7, "./m", "m.js", "other"), (8, "./o", "o.js", "default"), (9, "./s", "s.js", "a")]
    exports = spark.createDataFrame([("o.js", "default", "Origin"), ("m.js", "other", "unknown"), ("s.js", "a", "Own")], "path string, name string, local string")
    symbols = spark.createDataFrame([("o.js", "Origin"), ("s.js", "Own")], "path string, qualified string")
    found = resolve_exports(spark.createDataFrame(imports, "id int, specifier string, target_path string, name string"), exports, symbols, frame)
    assert {r.id: (r.target_path, r.target_qualified, r.dropped) for r in found.collect()} == {
        1: ("o.js", "Origin", False), 2: ("c12.js", "a", False), 3: (None, None, True), 4: ("m.js", "m.js", False), 5: (None, "react.useX", False), 6: (None, "react", False), 7: ("m.js", "other", False), 8: ("o.js", "Origin", False),
        9: ("s.js", "Own", False),
    }


def test_full_text(spark):
    rows = spark.createDataFrame([(1, "render_widget", "app::ui", None), (2, "Widget", "x", "renders a Café"), (3, "wid", "render", "cafe")], "id int, name string, qualified string, doc string")

    def hits(q):
        return [r.id for r in rows.filter(fts.matches(q, [F.col("name"), F.col("qualified"), F.col("doc")])).orderBy("id").collect()]

    assert hits("render widget") == [1] and hits("wid*") == [1, 2, 3] and hits('"render widget"') == [1] and hits('"widget render"') == []
    assert hits("café") == [2] and hits("render_widget") == [1]
    for bad in ("app::ui", "foo-bar", "a OR b", ""):
        with pytest.raises(ValueError):
            fts.parse(bad)


def test_names_and_versions():
    assert text.bare_name("a::b.c") == "c" and text.bare_name("A\\B") == "B" and text.bare_name("x:y") == "x:y"
    assert text.is_qualified("a.b") and not text.is_qualified("a:b")
    assert text.truncate_bytes("aé", 2) == "a…" and text.truncate_bytes("aé", 3) == "aé"
    assert text.matches_pattern("a/Gemfile", ["*.rb", "Gemfile"]) and not text.matches_pattern("a/x.py", ["*.rb"])
    assert text.config_hash({"b": b"2", "a": b"1"}) == text.config_hash({"a": b"1", "b": b"2"})


def test_server_references(spark):
    symbols = spark.createDataFrame([(1, "b1", "p", "A", "class", 0, 100, 1, 9), (2, "b1", "p", "A.f", "method", 10, 50, 2, 4), (3, "b2", "p", "g", "function", 0, 30, 1, 3)], "id long, blob_sha string, parser_id string, qualified string, kind string, byte_start long, byte_end long, line_start long, line_end long")
    entries = spark.createDataFrame([(1, "a.py", "b1"), (1, "b.py", "b2")], "manifest_id long, path string, blob_sha string")
    found = spark.createDataFrame([(1, "b2", "p", 5, 8, "call", "a.py", 3), (2, "b2", "p", 5, 8, "call", "out.py", 3), (3, "b2", "p", 40, 44, "import", "a.py", 99), (4, "b2", "p", 40, 44, "call", "a.py", 99)], "id long, blob_sha string, parser_id string, byte_start long, byte_end long, kind string, target_path string, target_line long")
    got = {r.id: (r.target_symbol_id, r.enclosing) for r in resolution.server_references(found, symbols, entries, 1).collect()}
    assert got == {1: (2, 3), 3: (None, None)}


def test_names_and_modules_of_columns(spark):
    names = spark.createDataFrame([("  ::a::b \t c ",), ("A.b",), ("::A\\b",), ("a　 b",), (None,)], "n string").select(text.normalize_qualified(F.col("n")).alias("n"))
    assert [r.n for r in names.collect()] == ["a::b c", "A.b", "A\\b", "a b", None]
    paths = ["src/shop/app.py", "shop/__init__.py", "top.py", "__init__.py", "a/b.pyi", "README.md", "a__init__.py"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(text.module_of(F.col("p")).alias("m"))
    assert [r.m for r in got.collect()] == ["src.shop.app", "shop", "top", None, None, None, "a__init__"]
    ids = spark.createDataFrame([("tree-sitter-rust@1.2.3",), ("custom-parser",), ("x@1",)], "p string").select(text.language_of(F.col("p")).alias("l"))
    assert [r.l for r in ids.collect()] == ["rust", "custom-parser", "x@1"]


def test_enrichment_tells_existing_analyzers_from_those_that_ran(spark):
    entries = spark.createDataFrame([(1, "a", "s1"), (1, "b", "s2"), (1, "c", "s3"), (1, "d", "s4")], "manifest_id long, path string, blob_sha string")
    blobs = spark.createDataFrame([("s1", "tree-sitter-a@1", "own"), ("s2", "tree-sitter-b", None), ("s3", "c", "other"), ("s4", "d", "x")], "blob_sha string, parser_id string, analyzer_id string")
    analyzers = spark.createDataFrame([("tree-sitter-a@1", "own"), ("tree-sitter-b", None), ("c", "own")], "parser_id string, analyzer_id string")
    got = {r.language: (r.tier, r.has_analyzer) for r in repos.enrichment(entries, blobs, analyzers).collect()}
    assert got == {"a": ("semantic", True), "b": ("syntactic", True), "c": ("syntactic", True), "d": ("syntactic", False)}
