"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame. All but the last keep the columns of docs, whatever further ones there are.

Cases, for all: an empty table gives an empty one; each of several equal rows is judged like the others, but the Jaccard stage keeps one of them; texts are read whole, however long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe as bpe_op
from sparkloom.llm import jaccard_join as jaccard_op
from sparkloom.llm import language_id as language_op
from sparkloom.llm import mixing as mixing_op
from sparkloom.llm import secret_scan

#: A document whose predicted language is less certain than this is rejected, as is one without a letter.
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language that is certain enough. A null text, or one without a letter, goes; without a language to learn from, only these do."""
    heads = language_op.train(docs.filter(~language_op.held_out()).select("doc_id", "lang", "text"))
    if not heads.languages:  # nothing to learn from: only texts without a letter can be rejected
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    row = docs.select("text", F.struct("*").alias("_row"))
    found = language_op.predict(row, heads)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("_row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies. Documents without a word, or without an id, all stay; an id of several texts is judged text by text."""
    return jaccard_op.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced by a mark; a null text stays null."""
    return secret_scan.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null sources are one source; documents without a word are drawn like others."""
    return mixing_op.mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each copy; a null or empty text has no tokens."""
    from sparkloom.llm.registry import tokenizer_path

    return bpe_op.digests(docs, tokenizer_path())
