"""Second layouts of fact tables: the same rows (or what is needed of them) in the order of another lookup.

A table is sorted by one name; a lookup by another one would scan all of it. Facts that have the layout give it under its own name; for others the
table itself stands in, so lookups ask for a layout and are right either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import fts

#: Layout: the table it is made of, the columns it is sorted by, and the columns it keeps (all if none are named).
SECOND: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "symbols_by_name": ("symbols", ("name", "id"), ()),
    "symbols_by_id": ("symbols", ("id",), ("id", "qualified", "blob_sha", "parser_id")),
    "refs_by_target": ("refs", ("target_qualified", "id"), ()),
    "refs_by_enclosing": ("refs", ("enclosing_id", "id"), ()),
    "refs_by_blob": ("refs", ("blob_sha", "byte_start", "id"), ()),
    "resolutions_by_target": ("resolutions", ("target_symbol_id", "id"), ("target_symbol_id", "id", "site_blob_sha", "site_parser_id", "site_byte_start", "site_byte_end", "kind", "blob_sha", "parser_id")),
    "postings": ("symbols", ("token", "id"), ("token", "id", "place", "position", "blob_sha", "parser_id")),
}
#: Values of a key that a lookup carries into the scan of the next table; with more, the tables are joined.
FEW_KEYS = 500


def made(layout: str, table: DataFrame) -> DataFrame:
    """The rows of a layout, unsorted. Columns that say which unit a fact belongs to stay where the table has them."""
    if layout == "postings":
        table = fts.postings(table, ["name", "qualified", "doc"])
    kept = SECOND[layout][2]
    return table.select(*[c for c in table.columns if not kept or c in kept or c == "generation"])


def second(facts, layout: str) -> DataFrame:
    """A layout of the facts, else the table in its own order."""
    try:
        return getattr(facts, layout)
    except AttributeError:
        return made(layout, getattr(facts, SECOND[layout][0]))


def few_keys(df: DataFrame, column: str) -> list | None:
    """The different values of a column, if they are few, to be filters of the next scan; nulls are left out."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(FEW_KEYS + 1).collect()
    return [r[0] for r in found] if len(found) <= FEW_KEYS else None


def at_keys(table: DataFrame, column: str, keys: list | None) -> DataFrame:
    """The table's rows with one of these values, or all if they are not known."""
    return table if keys is None else table.filter(F.col(column).isin(keys) if keys else F.lit(False))
