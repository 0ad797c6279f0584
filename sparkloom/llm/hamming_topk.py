"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is one or more 64-bit words, each cut into segments; an index row holds segment number, segment value and code. By
the pigeonhole principle, once all segments were searched up to radius r, and the first j of m up to r + 1,
every code within distance m * (r + 1) + j - 1 of a query was found. Search radii grow, segment by segment from
radius ``BY_SEGMENT`` on, until the distance of a query's last wanted neighbour lies within what is covered; only
queries that are not yet covered go on. A probe's partners are compared with the whole code in the join's condition and
kept only within the query's best distance so far, and only in the segment in which the steps meet the two codes first: no pair comes twice.

A round takes as many of these steps as are expected to meet ``AT_ONCE`` codes together, or one if it meets more. So few queries
among few codes, whose neighbours are far away, take few rounds, and the driver plans few jobs. Values to flip are a small table, not
literals, which the driver would keep in every plan's text.

Equal codes are one index entry with the smallest ids it can ever need (k + 1), found by a
window whose limit applies before the shuffle; queries with equal codes are searched once. So a code
that a third of all rows share costs one entry, and results stay exact.

Neighbours are ordered by (distance, id); a query is not its own neighbour. Cases: rows with a null id or code
(null or empty vector) have no code and are neither found nor answered; an id that stands in several rows has the smallest of its
codes; tables with fewer than k other ids give as many neighbours as there are; an empty table gives an empty result. Vectors may have any length: codes of fewer words than the longest count as
if zeros followed. A null number in a vector counts like one that is not positive. Columns besides id and code are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, settled

BITS = 64
#: From this radius on, segments are searched one after the other, to stop as early as possible.
BY_SEGMENT = 3
#: Values to try, or codes that they are expected to meet if these are more, up to which a round takes further steps.
AT_ONCE = 1 << 21
#: The same for the first round, in which no query has a best distance yet that its partners must be within.
AT_FIRST = AT_ONCE // 8
#: Values a query up to which a round takes further steps: what is broadcast, 8 bytes each.
MASKS = 1 << 16


def sign_code(vector: Column) -> Column:
    """The code of a vector: words of 64 bits, a bit for each number, set if it is positive."""
    starts = F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / BITS).cast("int"))
    zero = F.lit(0).cast("long")
    bit = lambda x: F.when(x > 0, 1).otherwise(0).cast("long")
    word = lambda k: F.aggregate(F.slice(vector, k * BITS + 1, F.lit(BITS)), zero, lambda a, x: F.shiftleft(a, 1).bitwiseOR(bit(x)))
    return F.when(F.size(vector) > 0, F.transform(starts, word))


def borders(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment of a word."""
    cuts = [BITS * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def values(code: Column, segments: int, words: int = 1) -> list[Column]:
    """The segments of all words."""
    return [F.shiftrightunsigned(code[k], a).bitwiseAND(F.lit((1 << w) - 1)).cast("int") for k in range(words) for a, w in borders(segments)]


def distance_of(a: Column, b: Column, words: int) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(words)])


def first_met(a: Column, b: Column, segments: int, words: int) -> Column:
    """The segment in which the steps, which go by radius and then by segment, meet a pair of codes first."""
    n = segments * words
    differ = [F.bit_count(x.bitwiseXOR(y)) * n + k for k, (x, y) in enumerate(zip(values(a, segments, words), values(b, segments, words)))]
    return (F.least(*differ) if n > 1 else differ[0]) % n


def masks(spark: SparkSession, widths: list[int], chosen: list[tuple[int, int]]) -> DataFrame:
    """(segment, mask): for each chosen (segment, radius) all values of the segment's width with ``radius`` ones."""
    found = [(j, sum(1 << b for b in bits)) for j, radius in chosen for bits in combinations(range(widths[j]), radius)]
    segment, mask = zip(*found)
    return spark.createDataFrame(pa.table({"segment": pa.array(segment, pa.int32()), "mask": pa.array(mask, pa.int32())}))


def steps(segments: int, words: int = 1):
    """(radius, segments to search now, distance covered afterwards), in order."""
    widths = [w for _, w in borders(segments)]
    segments *= words
    for r in range(max(widths) + 1):
        if r < BY_SEGMENT:
            yield r, range(segments), segments * (r + 1) - 1
        else:
            for j in range(segments):
                yield r, range(j, j + 1), segments * r + j


def next_round(todo: list, widths: list[int], cost: float, most: int = AT_ONCE) -> tuple[list[tuple[int, int]], int]:
    """(segment, radius) of the next round, whose steps leave ``todo``, and the distance covered afterwards; cost: of one value; most: of all."""
    chosen: list[tuple[int, int]] = []
    tried = covered = 0
    while todo:
        radius, now, reached = todo[0]
        more = sum(comb(widths[j], radius) for j in now)
        if tried and more and (tried + more > MASKS or (tried + more) * cost > most):
            break
        tried, covered = tried + more, reached
        chosen += [(j, radius) for j in now if radius <= widths[j]]
        del todo[0]
    return chosen, covered


def smallest(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """(query_id, rank, neighbour_id, distance) of each query (id, code) among all rows (id, code); a code is a number of 64 bits or an array of them.

    segments: of each word. Few wide ones suit many codes, as fewer codes share a value, but take more values to try for the same distance."""
    return settled(lambda: _search(rows, queries, k, segments), "neighbours")


def _search(rows: DataFrame, queries: DataFrame, k: int, segments: int) -> DataFrame:
    rows, queries = (df.select("id", F.array("code").alias("code") if dict(df.dtypes)["code"] == "bigint" else "code").filter("id IS NOT NULL AND size(code) > 0 AND code[0] IS NOT NULL") for df in (rows, queries))
    words = max((df.agg(F.max(F.size("code"))).first()[0] or 1 for df in (rows, queries)), default=1)
    zero = F.lit(0).cast("long")
    padded = F.concat("code", F.array_repeat(zero, words - F.size("code"))) if words > 1 else F.col("code")
    one = lambda df: df.withColumn("code", padded).groupBy("id").agg(F.min("code").alias("code"))
    wanted = cut(one(queries), "queries")
    # a query needs k neighbours besides itself
    few = smallest(one(rows), ["code"], ["id"], k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    parts = F.posexplode(F.array(*values(F.col("code"), segments, words)))
    index = cut(few.select("code", "ids", parts.alias("segment", "value")), "segments")

    spark = index.sparkSession
    codes, in_all = index.filter("segment = 0").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()  # ids, as far as it matters
    widths = [w for _, w in borders(segments)] * words
    to_meet = max(1.0, codes / 2 ** min(widths))
    active = cut(wanted.select(F.col("code").alias("query")).distinct().withColumn("most", F.lit(BITS * words)), "active")
    best = index.select(F.col("code").alias("query"), F.lit(0).alias("distance"), F.explode("ids").alias("id")).limit(0)
    rounds: list[DataFrame] = []
    todo = list(steps(segments, words))
    left = active.count() if in_all else 0
    while todo and left:
        chosen, covered = next_round(todo, widths, left * to_meet, AT_ONCE if rounds else AT_FIRST)
        own = active.withColumn("own", F.array(*values(F.col("query"), segments, words)))
        probes = own.crossJoin(F.broadcast(masks(spark, widths, chosen))).select("query", "most", "segment", F.col("own")[F.col("segment")].bitwiseXOR(F.col("mask")).alias("value"))
        distance = distance_of(F.col("query"), F.col("code"), words)
        # never broadcast: the planner takes exploded probes for as small as the queries they come from
        near = probes.hint("merge").join(index, ["segment", "value"]).filter((distance <= F.col("most")) & (first_met(F.col("query"), F.col("code"), segments, words) == F.col("segment")))
        near = near.select("query", distance.alias("distance"), F.explode("ids").alias("id")).unionAll(best)
        near = smallest(near, ["query"], ["distance", "id"], k + 1)
        all_of = W.partitionBy("query")
        n = F.count(F.lit(1)).over(all_of)
        last = F.when(F.lit(in_all <= k) & (n >= in_all), 0).when(n > k, F.max("distance").over(all_of))
        near = near.withColumn("last", last).withColumn("done", F.coalesce(F.col("last") <= covered, F.lit(False)))
        rounds.append(cut(near, "best"))
        best = rounds[-1].filter("NOT done").select("query", "distance", "id")
        reach = rounds[-1].select("query", "last", "done").distinct()
        active = active.join(reach, "query", "left").filter("done IS NULL OR NOT done").select("query", F.coalesce("last", "most").alias("most"))
        active = cut(active, "active")
        left = active.count()
    found = best
    if rounds:
        # one scan, however many rounds there were
        found = spark.read.schema(rounds[0].schema).parquet(*(df._cut_path for df in rounds)).filter("done").select("query", "distance", "id")
    others = wanted.withColumnRenamed("id", "query_id").join(found, F.col("code") == F.col("query")).filter(F.col("query_id") != F.col("id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    others = others.select("query_id", rank.cast("int").alias("rank"), F.col("id").alias("neighbour_id"), F.col("distance").cast("int").alias("distance"))
    return others.filter(F.col("rank") <= k)
