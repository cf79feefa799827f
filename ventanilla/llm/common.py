"""Helpers shared by the training-data operators: staged tables, text rows, components."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventanilla.session import checkpoint_dir

#: Stands for a null id inside an operator; it sorts below every real id.
NULL_ID = -(2 ** 63)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back.

    Cuts lineage: what follows reads the written table, so a lost executor
    costs only its running tasks.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (bigint) and the whole text (null: empty); other columns are left out."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def known_id(c: str = "doc_id") -> Column:
    """The id with ``NULL_ID`` for null, so joins and orders treat null as one id."""
    return F.coalesce(F.col(c), F.lit(NULL_ID).cast("bigint"))


def real_id(c: str = "doc_id") -> Column:
    """Back from ``known_id``: ``NULL_ID`` becomes null."""
    return F.when(F.col(c) != F.lit(NULL_ID).cast("bigint"), F.col(c))


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)``, root the smallest node.

    Alternating large-star and small-star contraction on DataFrames; every
    round is staged, so the plan never grows. A node's neighbours are only
    ever aggregated with ``min`` (combined before the shuffle), never
    collected. Ends when a round changes nothing.
    """
    cur = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where("a <> b").distinct(), "cc")
    sign = _fingerprint(cur)
    for _ in range(max_rounds):
        if sign[0] == 0:
            break
        sym = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(down.select("a", F.col("m").alias("b"))).distinct())
        cur = staged(small, "cc")
        now = _fingerprint(cur)
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def schema(ddl: str) -> T.StructType:
    """A schema from its DDL text."""
    return T.StructType.fromDDL(ddl)
