"""Generation counters of repositories: a state machine over events, as a pure function, a batch fold and a stream.

States hold desired, applied and forced generations, the one an attempt is at, when dirt was first seen, failures and the next retry.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BASE_NS, MOST_NS, MAX_ERROR = 5_000_000_000, 600_000_000_000, 512


@dataclass
class State:
    desired: int = 0
    applied: int = 0
    forced: int = 0
    attempt: int | None = None
    dirty_since: int | None = None
    failures: int = 0
    next_retry: int | None = None
    last_success: int | None = None
    last_error: str | None = None


def step(s: State, kind: str, at: int, generation: int | None = None, error: str | None = None) -> bool:
    """Apply an event; False if it does not fit the state and changes nothing."""
    if kind in ("dirty", "immediate", "force"):
        s.desired += 1
        s.dirty_since = at if s.dirty_since is None else s.dirty_since
        if kind != "dirty":
            s.next_retry = None
        if kind == "force":
            s.forced = s.desired
        return True
    if kind == "start":
        g = s.desired if generation is None else generation
        if s.attempt is not None or not s.applied < g <= s.desired:
            return False
        s.attempt = g
        return True
    if kind == "recover":
        s.attempt = None
        return True
    if s.attempt is None or (generation is not None and generation != s.attempt):
        return False
    if kind == "success":
        s.applied = max(s.applied, s.attempt)
        s.failures, s.next_retry, s.last_error, s.last_success = 0, None, None, at
        if s.applied >= s.desired:
            s.dirty_since = None
    elif kind == "failure":
        s.failures += 1
        s.next_retry = at + min(BASE_NS << min(max(s.failures - 1, 0), 20), MOST_NS)
        s.last_error = (error or "")[:MAX_ERROR]
    else:
        raise ValueError(kind)
    s.attempt = None
    return True


def fold_batch(events: DataFrame) -> DataFrame:
    """(repo, desired, forced, dirty_since) after dirty, immediate and force events (repo, at, seq, kind), without a state machine."""
    n = events.withColumn("g", F.row_number().over(W.partitionBy("repo").orderBy("at", "seq")).cast("long"))
    forced = F.coalesce(F.max(F.when(F.col("kind") == "force", F.col("g"))), F.lit(0).cast("long"))
    return n.groupBy("repo").agg(F.max("g").alias("desired"), forced.alias("forced"), F.min("at").alias("dirty_since"))


SCHEMA = "repo string, desired long, applied long, forced long, attempt long, dirty_since long, failures long, next_retry long, last_success long, last_error string"
STATE = SCHEMA.removeprefix("repo string, ")


def stream(events: DataFrame) -> DataFrame:
    """The state of each repository after every micro-batch of events (repo, at, seq, kind, generation, error)."""

    def fold(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names = [f.strip().split(" ")[0] for f in STATE.split(",")]
        s = State(**dict(zip(names, state.get, strict=True))) if state.exists else State()
        rows = sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: (r.at, r.seq))
        for r in rows:
            step(s, r.kind, int(r.at), None if pd.isna(r.generation) else int(r.generation), None if pd.isna(r.error) else r.error)
        state.update(tuple(asdict(s).values()))
        yield pd.DataFrame([{"repo": key[0], **asdict(s)}]).astype({n: "Int64" for n in names if n != "last_error"})

    return events.groupBy("repo").applyInPandasWithState(fold, SCHEMA, STATE, "update", "NoTimeout")
