"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ventanilla.llm import conversation_repair, line_dedup, mixing, ngram_join, nn_descent, packing, pii, sentencepiece_fst, spelling, suffix_dedup, topk_search, toxicity, url_filter
from ventanilla.llm.common import read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return pii.pii_report(read_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents`` on five-word shingles, Jaccard 0.75."""
    return ngram_join.near_duplicate_groups(read_table(spark, sf_dir, "documents"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of ``embeddings`` within their labels, cosine 0.98."""
    return nn_descent.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of every whole text of ``documents``."""
    return line_dedup.line_dedup_report(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` judged by the rule trie."""
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded to pieces and decoded again."""
    return sentencepiece_fst.sentencepiece_report(read_table(spark, sf_dir, "documents"),
                                                  public_tokenizers.path("piece_bpe_32k.model"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` in strings of 400 bytes that start twice, removed; documents that share 51 words in a row, told."""
    return suffix_dedup.suffix_dedup_report(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learned from ``labels``."""
    return toxicity.toxicity_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors by integer inner product for each 50th id of ``embeddings``."""
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of ``documents`` with its form, root and number of near words."""
    return spelling.spelling_report(read_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest of every conversation of ``conversations``, damaged by the contract's rule."""
    return conversation_repair.repair_report(read_table(spark, sf_dir, "conversations"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and taken words of every row of ``documents`` in the mix of all sources."""
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_ngram_join": op2_ngram_join,
    "op3_near_vectors": op3_near_vectors,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_topk": op10_topk,
    "op11_spelling": op11_spelling,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_mixing": op13_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.NGRAM_SQL,
    "op3_near_vectors": nn_descent.COSINE_SQL,
    "op4_line_dedup": line_dedup.LINE_SQL,
    "op6_url_filter": url_filter.URL_SQL,
    "op10_topk": topk_search.TOP_SQL,
    "op11_spelling": spelling.SPELLING_SQL,
}
