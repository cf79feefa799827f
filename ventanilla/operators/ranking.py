"""The position of a row inside its group, without one task per group.

The rows are range-partitioned by group and order, so a group of any size lies
over as many partitions as it needs. A row's position is its number inside its
partition's slice of the group plus the rows of the group in the partitions
before. Only one count per (partition, group) is gathered by group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ventanilla.session import checkpoint_dir


def with_position(df: DataFrame, keys, order: list[Column], name: str = "posicion") -> DataFrame:
    """``df`` with the 1-based position by ``order`` inside each group of ``keys`` (a null key is a group).

    ``order`` must tell the rows of a group apart. Which partition a row fell
    into is fixed by a checkpoint in the cluster's shared folder, as a plan
    that is run twice could cut the ranges differently. An empty frame stays
    empty; without ``keys`` all rows are one group.
    """
    keys = list(keys)
    spark = df.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = (df.repartitionByRange(parts, *[F.col(k).asc_nulls_first() for k in keys], *order)
             .withColumn("_part", F.spark_partition_id()).checkpoint())
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    slices = (cut.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_rows"))
                 .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
                 .drop("_rows").alias("s"))
    rows = cut.withColumn("_at", F.row_number().over(inside)).alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ["_part", *keys]])
    return rows.join(slices, same, "inner").select(
        *[F.col(f"r.{c}") for c in df.columns], (F.col("_at") + F.col("_before")).cast("bigint").alias(name))
