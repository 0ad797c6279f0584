"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources.shared import new_path

#: A word: a longest run of characters that are neither space nor U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that were cut within each open call of ``settled``.
_OPEN: list[list[DataFrame]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: later steps do not depend on
    this lineage, and lost executors cost nothing that was finished."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete cut tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, cut; every table that was cut on the way is deleted, also if it fails."""
    _OPEN.append([])
    try:
        df = make()
        path = new_path(df.sparkSession, name)
        df.write.parquet(path)
    finally:
        discard(*_OPEN.pop())
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def barrier(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows; the optimizer does not merge what computes ``columns`` into later expressions, where lambda
    functions would compute it again for each element."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))


def n_words(text) -> F.Column:
    """Words of a text (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of a bitmap of ids (8 MB).
MARK_BITS = 1 << 26


def place(column: Column) -> Column:
    """A value's bit in a bitmap of ids."""
    return F.pmod(F.xxhash64(column), F.lit(MARK_BITS))


def bitmap(ids: DataFrame) -> np.ndarray:
    """Bytes with a bit for each id's (id) place: of bounded size, whatever the number of ids."""
    h = ids.select(place(F.col("id")).alias("h"))
    rows = h.select(F.shiftright("h", 6).alias("w"), F.expr("shiftleft(1L, cast(h % 64 AS INT))").alias("b"))
    words = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(MARK_BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return bits.view(np.uint8)


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def among(column: Column, ids: DataFrame) -> Column:
    """Whether a value may be among ids (id): false for nearly all others, and never for one that is.

    If there are more ids than bits, all rows pass; a join decides about the rows that pass. So large rows are shuffled only where
    it matters."""
    shared = ids.sparkSession.sparkContext.broadcast(bitmap(ids))

    @F.pandas_udf(T.BooleanType())
    def look(at: pd.Series) -> pd.Series:
        return pd.Series(marked(shared.value, at.to_numpy()))

    return look(place(column))


def slices(batches: Iterable, rows: int = 256) -> Iterator:
    """Arrow batches in pieces of so many rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
