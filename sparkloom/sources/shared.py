"""The folder that the driver and all executors see, for tables that are written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, else the checkpoint folder set on its context, else one in the warehouse, which all of them share too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    return kept.get() if kept.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: later steps do not depend on its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, **more: int) -> Iterator[None]:
    """Jobs that run meanwhile send so many rows at once to Python (and settings of Arrow in ``more``, by their last name): each batch stands several times in memory."""
    wanted = {f"spark.sql.execution.arrow.{k}": v for k, v in {"maxRecordsPerBatch": rows, **more}.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
