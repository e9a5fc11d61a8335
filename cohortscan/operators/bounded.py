"""Joining per-group statistics back without a hot-key window.

A cohort or an outcome can own a third of all rows, so ``Window.partitionBy``
on such a key would put that third on one task.  Statistics are aggregated
with map-side combine instead and joined back by a plain join: adaptive
execution sends the statistics to the rows when they turn out small and splits
the partitions of hot keys otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a table that is expected to be small; right at any size."""
    return big.join(small, on, how)


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Equi-join whose hot keys are spread over ``salts`` tasks.

    The salt is a hash of the whole row, so a retried task repeats it.
    Only join types that keep or filter left rows are valid here.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"salted join does not support {how}")
    hashable = [f.name for f in big.schema.fields if f.dataType.typeName() != "map"]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, on + ["_salt"], how).drop("_salt")


def attach_stats(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Add group aggregates as columns (a skew-safe unordered window)."""
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return join_small(df, stats, keys, "inner")
