"""Positions inside groups that lie over several range partitions."""

import random

from pyspark.sql import functions as F

from ventanilla.operators.ranking import with_position


def test_position_in_a_hot_group_null_keys_and_repeated_counts(spark):
    rng = random.Random(4)
    rows = [(None if g == 3 else g, rng.randint(0, 40), f"c{i:05d}") for i in range(3000)
            for g in [rng.choice([1, 1, 1, 1, 2, 3])]]
    df = spark.createDataFrame(rows, "oficina int, n int, nombre string").repartition(5)
    got = {(r.oficina, r.nombre): r.posicion for r in
           with_position(df, ["oficina"], [F.col("n").desc(), F.col("nombre").asc()]).collect()}
    want = {}
    for g in (1, 2, None):
        for at, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[g, r[2]] = at
    assert got == want


def test_position_of_an_empty_frame_and_without_keys(spark):
    ddl = "oficina int, n int"
    empty = with_position(spark.createDataFrame([], ddl), ["oficina"], [F.col("n").asc()])
    assert empty.columns == ["oficina", "n", "posicion"] and empty.count() == 0
    all_rows = with_position(spark.range(0, 500, 1, 7).toDF("n"), [], [F.col("n").desc()], "lugar")
    assert all(r.n + r.lugar == 500 for r in all_rows.collect())


def test_no_group_is_gathered_in_one_task(spark):
    df = with_position(spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("n")), ["k"], [F.col("n").asc()])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    by_group = [line for line in plan.split("\n") if "Window" in line and "row_number" in line]
    assert by_group and all("_part" in line for line in by_group)
