"""URL filter: a trie over reversed host labels, then path segments.

``judge`` looks every url up in allow and block entries (host, path). An entry fits its host and
all its subdomains when the url's path starts with the entry's path; of the entries that fit, the
longest (code points of host + path) wins, and of equally long ones the one with more host labels.
A url that no entry fits gets the default verdict.

Cases: a null url, or one without ``://``, has an empty host and path, fits no entry and gets the
default verdict; so does an empty url. A path that is empty does not start with ``/``, so entries
whose path is ``/`` do not fit it. Repeated urls are judged alike, row by row. An empty table gives
an empty result with the same columns. Columns of the input that clash with the four result
columns are replaced; all others pass through. When an entry is listed as both allow and block,
block wins.

The trie is shipped to the executors; ``MAX_ENTRIES`` bounds it. Beyond that bound ``judge`` joins the
urls with the entry table on host suffixes instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (verdict, host, path)
Entry = tuple[str, str, str]
#: Most entries that are shipped as a trie (some 200 bytes each).
MAX_ENTRIES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url) -> F.Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


class UrlTrie:
    """Nodes are dicts: host labels from the right, then, below the key ``/``, path segments.

    At a path node the key ``$`` holds the entries that end there as (rest of the path after the
    last whole segment, verdict, rule); the rest is a prefix of the url's remaining path."""

    def __init__(self, entries: Iterable[Entry]):
        self.root: dict = {}
        seen: dict[tuple[str, str], str] = {}
        for verdict, host, path in entries:
            if seen.get((host, path)) != "block":
                seen[host, path] = verdict
        for (host, path), verdict in seen.items():
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no label holds a slash
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(("s", segment), {})
            node.setdefault("$", []).append((rest, verdict, host + path, host.count(".")))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest entry that fits."""
        best: tuple[int, int, str, str] | None = None
        segments = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at, k = node.get("/"), 0
            while at is not None:
                for rest, verdict, rule, dots in at.get("$", ()):
                    if k < len(segments) and segments[k].startswith(rest):
                        best = max(best or (-1, 0, "", ""), (len(rule), dots, rule, verdict))
                # a whole segment is one that a slash ends
                at = at.get(("s", segments[k])) if k < len(segments) - 1 else None
                k += 1
        return best and (best[2], best[3])


def judge(df: DataFrame, entries: list[Entry] | DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """The rows of ``df`` with host, path, rule and verdict.

    ``entries``: a list, or a DataFrame (verdict, host, path) of any size."""
    spark = df.sparkSession
    rows = df.drop(*[c for c in df.columns if c.lower() in ("host", "path", "rule", "verdict") and c != url])
    rows = rows.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if isinstance(entries, DataFrame):
        few = entries.select("verdict", "host", "path").limit(MAX_ENTRIES + 1).collect()
        if len(few) <= MAX_ENTRIES:
            entries = [tuple(r) for r in few]
    elif len(entries) > MAX_ENTRIES:
        entries = spark.createDataFrame(entries, "verdict string, host string, path string")
    if isinstance(entries, DataFrame):
        return _judge_by_join(rows, entries, default)

    trie = spark.sparkContext.broadcast(UrlTrie(entries))

    @F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    def look_up(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        found = [find(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return rows.withColumn("_found", look_up("host", "path")).select("*", "_found.rule", "_found.verdict").drop("_found")


def _judge_by_join(rows: DataFrame, entries: DataFrame, default: str) -> DataFrame:
    """The way beyond MAX_ENTRIES: distinct (host, path) keys, one row per host suffix, an equi-join
    on the suffix with AQE's skew handling, the longest entry per key, and a join back."""
    rules = entries.groupBy("host", "path").agg(F.min_by("verdict", F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("verdict"))
    rules = rules.select(F.col("host").alias("_suffix"), F.col("path").alias("_prefix"), "verdict")
    labels = F.split("host", r"\.")
    keys = rows.select("host", "path").distinct()
    hits = (
        keys.withColumn("_suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))))
        .join(rules, "_suffix")
        .filter(F.col("path").startswith(F.col("_prefix")))
        .withColumn("rule", F.concat("_suffix", "_prefix"))
    )
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), F.size(F.split("_suffix", r"\.")), "rule", "verdict")).alias("_b"))
    best = best.select("host", "path", "_b.rule", "_b.verdict")
    return rows.join(best, ["host", "path"], "left").select(*rows.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
