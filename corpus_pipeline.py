"""Corpus pipeline: toxicity, line dedup, near-duplicate documents, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before kept. All but the last return the columns of ``documents``; the last
returns the packed pieces with their ids. ``run`` writes each stage as Parquet
in the cluster's shared folder and reads it again, so a lost executor costs
only the running stage's tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ventanilla.llm import line_dedup, ngram_join, packing, pii, toxicity
from ventanilla.llm.common import read_table, staged


#: Rows of an Arrow batch: a thousand texts at a time are in memory, not ten thousand.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_ROWS = 1000


def _short_batches(spark: SparkSession) -> None:
    if int(spark.conf.get(BATCH_ROWS)) > MOST_ROWS:
        spark.conf.set(BATCH_ROWS, str(MOST_ROWS))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from ``labels``."""
    _short_batches(spark)
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay only in the one with the largest id."""
    _short_batches(spark)
    return line_dedup.drop_repeated_lines(docs)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    _short_batches(spark)
    return ngram_join.keep_one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind."""
    _short_batches(spark)
    return pii.redact_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids packed into sequences of at most 2048."""
    _short_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_join", ngram_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express the toxicity machine and the packing rule; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
