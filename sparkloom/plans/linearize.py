"""Ancestor chains of types, by each language's own rule, with bounded walks; and their use to dispatch calls.

The ancestors of all classes are found together, by doubling: who is reached in at most 1, 2, 4 ... steps. A class's own edges and those of its ancestors then meet, so what a task holds at
a time is one class with its ancestors, whatever the size of its workspace.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import written

MAX_DEPTH, MAX_DFS, MAX_BFS = 64, 256, 512
Bases = dict[str, list[str]]


def height(name: str, bases: Bases) -> float:
    """The longest way up from a class; infinite in a loop."""
    known: dict[str, float] = {}
    todo = [(name, iter(bases.get(name, [])))]
    open_ = {name}
    while todo:
        own, rest = todo[-1]
        p = next((p for p in rest if p not in known), None)
        if p is None:
            known[own] = max((known[p] + 1 for p in bases.get(own, [])), default=0)
            open_.discard(own)
            todo.pop()
        elif p in open_ or len(todo) > MAX_DEPTH:
            return float("inf")
        else:
            open_.add(p)
            todo.append((p, iter(bases.get(p, []))))
    return known[name]


def c3(name: str, bases: Bases) -> list[str] | None:
    """Python's order; None for an inconsistent or too deep hierarchy. Bases outside the workspace stay, without ancestors."""
    return _c3(name, bases, {}) if height(name, bases) <= MAX_DEPTH else None


def _c3(name: str, bases: Bases, known: dict[str, list[str] | None]) -> list[str] | None:
    """The bases' orders and the list of bases, merged; each class once."""
    if name not in known:
        parents = bases.get(name, [])
        lists = [_c3(p, bases, known) for p in parents]
        known[name] = None if None in lists else merged(name, [x for x in [*lists, parents] if x])
    return known[name]


def merged(name: str, lists: list[list[str]]) -> list[str] | None:
    """A class and lists of others in an order that keeps that of every list, always the first head that is in no other list's tail."""
    out, at = [name], [0] * len(lists)
    tails: Counter[str] = Counter(x for own in lists for x in own[1:])
    while any(k < len(own) for k, own in zip(at, lists, strict=True)):
        head = next((own[k] for k, own in zip(at, lists, strict=True) if k < len(own) and not tails[own[k]]), None)
        if head is None:
            return None
        out.append(head)
        for i, own in enumerate(lists):
            if at[i] < len(own) and own[at[i]] == head:
                at[i] += 1
                if at[i] < len(own):
                    tails[own[at[i]]] -= 1
    return out


def depth_first(name: str, bases: Bases, most: int = MAX_DFS) -> list[str]:
    out, todo = [], [name]
    while todo and len(out) < most:
        x = todo.pop()
        if x not in out:
            out.append(x)
            todo += reversed(bases.get(x, []))
    return out


def breadth_first(name: str, bases: Bases, most: int = MAX_BFS) -> list[str]:
    out, todo = [], deque([name])
    while todo and len(out) < most:
        x = todo.popleft()
        if x not in out:
            out.append(x)
            todo += bases.get(x, [])
    return out


def python_order(name: str, bases: Bases) -> list[str]:
    return c3(name, bases) or depth_first(name, bases)


def ruby_order(name: str, kinds: dict[str, dict[str, list[str]]], singleton: bool = False) -> list[str]:
    """Prepended modules (last first), the class, included ones (last first), then its superclass alike; the singleton chain: extended modules."""
    out: list[str] = []
    own: str | None = name
    while own is not None and own not in out and len(out) < MAX_DFS:
        k = kinds.get(own, {})
        before, after = ([], k.get("extend", [])) if singleton else (k.get("prepend", []), k.get("include", []))
        for group, at_self in ((before, False), ((own,), True), (after, False)):
            for m in group if at_self else reversed(group):
                if m not in out:
                    out.append(m)
        own = next(iter(k.get("inherit", [])), None)
    return out


def php_order(name: str, kinds: dict[str, dict[str, list[str]]]) -> list[str]:
    """The class, its traits, its parent alike, then interfaces."""
    out, interfaces, own = [], [], name
    while own is not None and own not in out and len(out) < MAX_DFS:
        k = kinds.get(own, {})
        out += [x for x in [own, *k.get("mixin", [])] if x not in out]
        interfaces += k.get("implement", [])
        own = next(iter(k.get("inherit", [])), None)
    for i in interfaces:
        out += [x for x in depth_first(i, {n: v.get("inherit", []) for n, v in kinds.items()}) if x not in out]
    return out


def ancestors(edges: DataFrame) -> DataFrame:
    """(workspace, class, ancestor) of classes up to ``MAX_BFS`` steps away, a class itself only if it is in a loop."""
    reached = written(edges.select("workspace", "class", F.col("base").alias("ancestor")).distinct(), "reached")
    n, steps = reached.count(), 1
    while steps < MAX_BFS:
        on = reached.select("workspace", F.col("class").alias("ancestor"), F.col("ancestor").alias("_next"))
        further = reached.join(on, ["workspace", "ancestor"]).select("workspace", "class", F.col("_next").alias("ancestor"))
        reached = written(reached.unionAll(further).distinct(), "reached")
        before, n, steps = n, reached.count(), 2 * steps
        if n == before:
            break
    return reached


def linearized(edges: DataFrame, language: str = "python") -> DataFrame:
    """(workspace, class, position, ancestor) from edges (workspace, class, base, kind, ordinal)."""
    edges = edges.select("workspace", "class", "base", "kind", "ordinal")
    classes = edges.select("workspace", "class").distinct()
    around = ancestors(edges).unionAll(classes.select("workspace", "class", F.col("class").alias("ancestor"))).distinct()
    own = around.select("workspace", F.col("class").alias("root"), F.col("ancestor").alias("class")).join(edges, ["workspace", "class"])

    def order_of(root: str, rows: list[tuple]) -> list[str]:
        kinds: dict[str, dict[str, list[str]]] = {}
        for c, base, kind in rows:
            kinds.setdefault(c, {}).setdefault(kind, []).append(base)
        if language == "ruby":
            return ruby_order(root, kinds)
        if language == "php":
            return php_order(root, kinds)
        bases = {c: [b for group in k.values() for b in group] for c, k in kinds.items()}
        return python_order(root, bases) if language == "python" else breadth_first(root, bases)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((r[:2], r[2:]) for b in batches for r in zip(*(b[c] for c in ("workspace", "root", "class", "base", "kind")), strict=True))
        out = []
        for (workspace, root), group in groupby(rows, key=lambda r: r[0]):
            out += [(workspace, root, k, a) for k, a in enumerate(order_of(root, [r for _, r in group]))]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["workspace", "class", "position", "ancestor"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["workspace", "class", "position", "ancestor"])

    dealt = own.repartition("workspace", "root").sortWithinPartitions("workspace", "root", "class", "ordinal", "base")
    chains = dealt.mapInPandas(run, "workspace string, class string, position int, ancestor string")
    alone = edges.select("workspace", F.col("base").alias("class")).distinct().join(classes, ["workspace", "class"], "left_anti")
    return chains.unionAll(alone.select("workspace", "class", F.lit(0).alias("position"), F.col("class").alias("ancestor")))


def receiver_classes(calls: DataFrame, names: DataFrame) -> DataFrame:
    """``calls`` (id, workspace, receiver, enclosing_class, method) with the class to look in and the position of its chain after which to look.

    ``self`` and ``cls`` are the class around the call, ``super()`` is what follows it in its own chain; another receiver is a class by the name that it has in the workspace (names: workspace, name, class), as written or
    imported under an alias. Of several such classes there is none."""
    one = names.groupBy("workspace", "name").agg(F.min("class").alias("_class"), F.count_distinct("class").alias("_n")).filter("_n = 1").select("workspace", F.col("name").alias("receiver"), "_class")
    own = F.col("receiver").isin("self", "cls", "super()")
    found = calls.join(one, ["workspace", "receiver"], "left")
    after = F.when(F.col("receiver") == "super()", 0).otherwise(-1)
    return found.select(*calls.columns, F.when(own, F.col("enclosing_class")).otherwise(F.col("_class")).alias("class"), after.alias("after"))


def dispatched(calls: DataFrame, chains: DataFrame, methods: DataFrame) -> DataFrame:
    """``calls`` (id, workspace, class, method, and after: a position of the chain) with the first ancestor (beyond that position) that has the method (owner), if any."""
    calls = calls if "after" in calls.columns else calls.withColumn("after", F.lit(-1))
    hits = calls.join(chains, ["workspace", "class"]).join(methods.select("workspace", F.col("class").alias("ancestor"), "method"), ["workspace", "ancestor", "method"]).filter("position > after")
    best = hits.groupBy("id").agg(F.min_by("ancestor", "position").alias("owner"))
    return calls.drop("after").join(best, "id", "left")


def python_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """``imports`` (id, module, target, name) with target_path: of ``module.name`` if that is a module, else of the module itself.

    module: the importing file's own; relative targets climb from its package. modules: (module, path, is_package)."""
    dots = F.length(F.regexp_extract("target", r"^(\.*)", 1))
    rest = F.regexp_replace("target", r"^\.+", "")
    own = imports.join(modules.select("module", "is_package"), "module", "left")
    parts = F.split("module", r"\.")
    keep = F.size(parts) - dots + F.when(F.coalesce("is_package", F.lit(False)), 1).otherwise(0)
    package = F.array_join(F.slice(parts, 1, F.greatest(keep, F.lit(0))), ".")
    base = F.when(dots == 0, rest).otherwise(F.concat_ws(".", F.when(package != "", package), F.when(rest != "", rest)))
    own = own.withColumn("_base", base)
    as_module = modules.select(F.col("module").alias("_whole"), F.col("path").alias("_p1"))
    itself = modules.select(F.col("module").alias("_base"), F.col("path").alias("_p2"))
    whole = F.concat_ws(".", F.when(F.col("_base") != "", F.col("_base")), "name")
    found = own.withColumn("_whole", F.when(F.col("name").isNotNull(), whole)).join(as_module, "_whole", "left").join(itself, "_base", "left")
    return found.select(*imports.columns, F.coalesce("_p1", "_p2").alias("target_path"))


def relative_specifiers(imports: DataFrame, files: DataFrame) -> DataFrame:
    """JavaScript ``imports`` (id, path, specifier) with target_path: the first file (path) of the usual candidates; bare specifiers have none."""
    endings = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js"]
    folder = F.regexp_replace("path", "[^/]*$", "")
    parts = F.split(F.concat(folder, F.col("specifier")), "/")
    empty = F.array().cast("array<string>")
    joined = F.aggregate(parts, empty, lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    local = imports.filter(F.col("specifier").rlike(r"^\.{1,2}(/|$)")).withColumn("_base", F.array_join(joined, "/"))
    tried = local.select("id", "_base", F.posexplode(F.array(*[F.lit(e) for e in endings])).alias("_k", "_e"))
    hits = tried.withColumn("_file", F.concat("_base", "_e")).join(files.select(F.col("path").alias("_file")), "_file")
    best = hits.groupBy("id").agg(F.min_by("_file", "_k").alias("target_path"))
    return imports.join(best, "id", "left")
