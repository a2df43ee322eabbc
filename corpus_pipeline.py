"""The corpus pipeline: five stages over documents, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import byte_bpe, decontaminate, jaccard_join, langid, line_dedup
from marlstone.llm.common import Workspace, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or whose language the calibrated model rejects."""
    return langid.keep_accepted(docs, langid.fit(spark, docs))


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand, or nearly stand, in an earlier place; documents that lose all lines go.

    Lines of under ten characters, numbers and marks of lists, go for equal ones only.  Null texts stay.
    """
    kept = line_dedup.dedup_lines(spark, docs, bound=1, edit_chars=10)
    kept = kept.where(~((F.col("n_removed") > 0) & (F.trim("text") == "")))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return jaccard_join.keep_one(spark, docs, percent=75, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold three quarters or more of a benchmark item's shingles."""
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"), least=0.75)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, decoded again: doc_id, n_tokens and digests."""
    # Python workers live on from stage to stage, so this one remembers fewer words than it does alone, and not for long
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, remembered=50_000, tidy=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("byte_bpe", encoding),
]

#: Neither the language model nor the encoding can be said in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs, saved = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        ws.drop(*saved)  # what the stage before left has been read
        saved = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
