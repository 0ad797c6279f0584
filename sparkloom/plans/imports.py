"""Resolution of imports against a workspace.

Python: an index of its modules and symbols, and ranked candidates for each import.

The index knows every module and symbol by its dotted name and by each suffix of it, so that ``shop.app`` finds ``src/shop/app.py`` without a packaging file. Where several files
give a name, the first in order of paths has it; within a file classes come before functions, in order of place. Both indexes are one aggregation, added up before the shuffle, so a suffix that
many files share is no hot group.

JavaScript: names that a file passes on (``export { a } from './b'``) are followed to the file that defines them by pointer jumping, all chains at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import written


def dotted_suffixes(name: Column) -> Column:
    """``a.b.c``, ``b.c`` and ``c`` of ``a.b.c``."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def module_index(files: DataFrame) -> DataFrame:
    """(key, path) of the modules of files (path, module); files without a module name have none."""
    named = files.filter(F.col("module") != "").select("path", F.explode(dotted_suffixes(F.col("module"))).alias("key"))
    return named.groupBy("key").agg(F.min("path").alias("path"))


def symbol_index(symbols: DataFrame) -> DataFrame:
    """(key, path, qualified) of symbols (path, qualified, is_class, place)."""
    named = symbols.select("path", "qualified", "is_class", "place", F.posexplode(dotted_suffixes(F.col("qualified"))).alias("_k", "key"))
    order = F.struct("path", ~F.col("is_class"), "place", "qualified", "_k")
    return named.groupBy("key").agg(F.min_by(F.struct("path", "qualified"), order).alias("_first")).select("key", "_first.*")


def absolute_module(target: Column, module: Column, is_package: Column) -> Column:
    """The module that an import names: as written, or from the importing file's package, a level up for each further dot; null beyond the top."""
    dots = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    rest = F.regexp_replace(target, r"^\.+", "")
    parts = F.split(module, r"\.")
    keep = F.size(parts) - F.when(is_package, 0).otherwise(1) - (dots - 1)
    base = F.array_join(F.slice(parts, 1, F.greatest(keep, F.lit(0))), ".")
    joined = F.when(rest == "", base).when(base == "", rest).otherwise(F.concat(base, F.lit("."), rest))
    return F.when(dots == 0, target).when(module.isNotNull() & (module != "") & (keep >= 0), joined)


def resolve_imports(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``imports`` (id, path, target, name) with target_path and target_qualified, both null if nothing in the workspace is meant.

    name: what is imported from the target, null for the module itself, ``*`` for all of it. files (path, module, is_package) and symbols (path, qualified, is_class, place) are the workspace.
    Of ``from m import n`` the first of these that exists counts: the symbol or module ``m.n``, a symbol ``n`` anywhere, the module ``m``. A star stands for the module, known or not."""
    own = imports.join(files.select("path", "module", "is_package"), "path", "left")
    base = absolute_module(F.col("target"), F.col("module"), F.coalesce("is_package", F.lit(False)))
    own = own.select("id", "name", "target", base.alias("_base"))
    of = lambda rank, key, symbol, module, always=False: F.struct(F.lit(rank).alias("rank"), key.alias("key"), F.lit(symbol).alias("symbol"), F.lit(module).alias("module"), F.lit(always).alias("always"))
    whole = F.concat("_base", F.lit("."), "name")  # at the top, where the base is empty, no name is like it
    some = F.when(F.col("_base").isNotNull(), F.array(of(0, whole, True, True), of(1, F.col("name"), True, False), of(2, F.col("_base"), False, True)))
    tried = F.when(F.col("name").isNull(), F.array(of(0, F.col("target"), False, True))).when(F.col("name") == "*", F.array(of(0, F.col("_base"), False, False, True))).otherwise(some)
    rows = own.select("id", F.inline(tried)).filter("key IS NOT NULL")
    rows = rows.join(module_index(files).select("key", F.col("path").alias("_module")), "key", "left")
    rows = rows.join(symbol_index(symbols).select("key", F.col("path").alias("_path"), F.col("qualified").alias("_qualified")), "key", "left")
    found = rows.filter(F.col("always") | (F.col("symbol") & F.col("_path").isNotNull()) | (F.col("module") & F.col("_module").isNotNull()))
    hit = F.struct(F.coalesce("_path", "_module").alias("target_path"), F.coalesce("_qualified", "key").alias("target_qualified"))
    best = found.groupBy("id").agg(F.min_by(hit, "rank").alias("_hit"))
    return imports.join(best, "id", "left").select(*imports.columns, "_hit.target_path", "_hit.target_qualified")


#: Fixed value: so many times a name may be passed on. Chains that are longer, or lead in a circle, are dropped.
MAX_HOPS = 8


def flattened_exports(reexports: DataFrame) -> DataFrame:
    """``reexports`` (path, name, to_path, to_name), one row for each name that a file passes on, with the end of each chain (origin_path, origin_name; null where it is dropped) and dropped."""
    keys = reexports.select("path", "name").distinct()
    at = reexports.groupBy("path", "name").agg(F.min(F.struct("to_path", "to_name")).alias("_to")).select("path", "name", "_to.*")
    hops = 1
    while hops < MAX_HOPS:  # each round doubles the length of all pointers that are not at their end
        on = at.select(F.col("path").alias("to_path"), F.col("name").alias("to_name"), F.col("to_path").alias("_path"), F.col("to_name").alias("_name"))
        jumped = at.join(on, ["to_path", "to_name"], "left").select("path", "name", F.coalesce("_path", "to_path").alias("to_path"), F.coalesce("_name", "to_name").alias("to_name"))
        at, hops = written(jumped, "exports"), 2 * hops
    more = keys.select(F.col("path").alias("to_path"), F.col("name").alias("to_name"), F.lit(True).alias("_more"))
    out = at.join(more, ["to_path", "to_name"], "left").withColumn("dropped", F.coalesce("_more", F.lit(False)))
    return out.select("path", "name", *[F.when(~F.col("dropped"), F.col(c)).alias(o) for c, o in (("to_path", "origin_path"), ("to_name", "origin_name"))], "dropped")


def resolve_exports(imports: DataFrame, exports: DataFrame, symbols: DataFrame, reexports: DataFrame) -> DataFrame:
    """``imports`` (id, specifier, target_path, name) with what they mean: target_path, target_qualified, and dropped where a chain ends nowhere.

    exports (path, name, local): names under which a file gives its own symbols; symbols (path, qualified). A file's own export counts first, then the end of a chain, as a symbol or by its
    name, then the name in the target itself; an import of a whole file means the file; one from outside of the workspace keeps its specifier."""
    defined = exports.join(symbols.select("path", F.col("qualified").alias("local")).distinct(), ["path", "local"]).groupBy("path", "name").agg(F.min("local").alias("_symbol"))
    chains = flattened_exports(reexports).select(F.col("path").alias("target_path"), "name", "origin_path", "origin_name", "dropped")
    own = defined.select(F.col("path").alias("target_path"), "name", F.col("_symbol").alias("_own"))
    ends = defined.select(F.col("path").alias("origin_path"), F.col("name").alias("origin_name"), F.col("_symbol").alias("_end"))
    rows = imports.join(own, ["target_path", "name"], "left").join(chains, ["target_path", "name"], "left").join(ends, ["origin_path", "origin_name"], "left")
    here, gone = F.col("target_path").isNotNull(), F.coalesce("dropped", F.lit(False)) & F.col("_own").isNull()
    path = F.when(F.col("_own").isNotNull(), F.col("target_path")).when(~gone, F.coalesce("origin_path", "target_path"))
    outside = F.concat_ws(".", "specifier", "name")
    name = F.when(~here, outside).when(F.col("name").isNull(), F.col("target_path")).when(~gone, F.coalesce("_own", "_end", "origin_name", "name"))
    return rows.select("id", path.alias("target_path"), name.alias("target_qualified"), gone.alias("dropped"))
