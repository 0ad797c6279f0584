"""The corpus pipeline: stages over ``documents``, each a function (spark, docs, sf_dir) -> DataFrame.

``run`` writes every stage's result as Parquet in the session's shared folder and reads it again
as the next stage's documents. What a stage wrote besides, and its own input, is deleted when it is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import stages
from sparkloom.llm.common import discard, settled, table

STAGES = [
    ("language ID", stages.language_id),
    ("n-gram Jaccard join", stages.jaccard_join),
    ("secret scans", stages.secret_scans),
    ("mixing", stages.mixing),
    ("BPE", stages.bpe),
]

#: Language ID, secret scans and BPE cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = docs
        docs = settled(lambda: stage(spark, before, sf_dir), f"stage{k}")
        if k:
            discard(before)
    return docs
