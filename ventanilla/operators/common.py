"""Small shared DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, per_group: DataFrame, keys) -> DataFrame:
    """Attach per-group aggregates to every row of ``df``.

    With keys: an equi-join on them (one row per group on the right, so AQE
    broadcasts it when measured small and splits skewed partitions if not).
    Without keys (one whole-table group): a scalar subquery, evaluated once
    and inlined -- no join at all."""
    keys = list(keys)
    if keys:
        return df.join(per_group, keys, "inner")
    cols = per_group.columns
    packed = per_group.select(F.struct(*cols).alias("_g")).scalar()
    return df.withColumns({c: packed[c] for c in cols})
