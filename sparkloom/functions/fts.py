"""Full-text match over several columns: words in any column, ordered phrases, prefixes.

Text is cut into runs of letters and digits in lower case, accents kept. A query is a list of
words, ``"ordered phrases"`` and ``prefix*`` terms, all of which must match; a phrase must stand within one column.
Other query syntax raises ValueError.

Facts keep postings: a row per token of a row's columns, sorted by token. A query reads the row groups of its tokens alone; words meet by their rows, phrases by the
difference of positions as well. Without postings columns are held as texts of tokens with a space around each, so that every term is one ``contains`` inside generated code.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def tokens(text: Column) -> Column:
    """The tokens of a text, each between spaces; a single space if there are none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))


def parse(query: str) -> list[tuple[list[str], bool]]:
    """(tokens, whether the last is a prefix) of each term."""
    terms: list[tuple[list[str], bool]] = []
    at = 0
    while at < len(query):
        if query[at].isspace():
            at += 1
            continue
        m = re.compile(r'"((?:[^"]|"")*)"(\s*\*)?').match(query, at) or re.compile(r"([\w]+)(\*)?(?=\s|$)").match(query, at)
        if m is None or m[0] in ("AND", "OR", "NOT", "NEAR"):
            raise ValueError(f"unsupported full-text syntax: {query!r}")
        words = WORD.findall(m[1].lower())
        if words:
            terms.append((words, bool(m[2])))
        at = m.end()
    if not terms:
        raise ValueError("an empty full-text query")
    return terms


def matches(query: str, columns: list[Column]) -> Column:
    """Whether a row's columns match."""
    indexed = [tokens(c) for c in columns]

    def term(words: list[str], prefix: bool) -> Column:
        wanted = " " + " ".join(words) + ("" if prefix else " ")
        return reduce(lambda a, b: a | b, [t.contains(wanted) for t in indexed])

    return reduce(lambda a, b: a & b, [term(*t) for t in parse(query)])


def postings(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(token, place, position) beside the columns of each row: the tokens of its columns (place: which one), in order."""
    def listed(place: int, column: str) -> Column:
        found = F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
        return F.transform(found, lambda x, i: F.struct(x.alias("token"), F.lit(place).alias("place"), i.alias("position")))

    each = F.flatten(F.array(*[listed(*x) for x in enumerate(columns)]))
    return rows.select("*", F.inline(each))


def _at(words: DataFrame, word: str, prefix: bool) -> DataFrame:
    return words.filter(F.col("token").startswith(word) if prefix else F.col("token") == word)


def search(words: DataFrame, query: str) -> DataFrame:
    """The ids (id) of the rows that match, from their postings."""
    terms = []
    for t, (tokens_, prefix) in enumerate(parse(query)):
        last = len(tokens_) - 1
        if not last:
            found = _at(words, tokens_[0], prefix).select("id")
        else:
            parts = [_at(words, w, prefix and k == last).select("id", "place", (F.col("position") - k).alias("start"), F.lit(k).alias("k")) for k, w in enumerate(tokens_)]
            together = reduce(lambda a, b: a.unionAll(b), parts).groupBy("id", "place", "start").agg(F.count_distinct("k").alias("n"))
            found = together.filter(F.col("n") == len(tokens_)).select("id")
        terms.append(found.withColumn("t", F.lit(t)))
    every = reduce(lambda a, b: a.unionAll(b), terms).groupBy("id").agg(F.count_distinct("t").alias("n"))
    return every.filter(F.col("n") == len(terms)).select("id")
