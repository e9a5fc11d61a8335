"""Ordered per-group operations that never need a whole group on one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscan.operators.bounded import join_small
from cohortscan.session import checkpointed


def ordinal(
    df: DataFrame, keys: list[str], order: list[str], slice_by: Column, name: str
) -> DataFrame:
    """Row number 1..n per group; ``slice_by`` must rise with the order."""
    sliced = df.withColumn("_slice", slice_by)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    before = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        sliced.withColumn("_inner", F.row_number().over(inside))
        .join(offsets, keys + ["_slice"], "inner")
        .withColumn(name, (F.col("_inner") + F.col("_offset")).cast("long"))
        .drop("_slice", "_inner", "_offset")
    )


def global_rank(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Row number per group from one range-partitioned sort.

    Works for any value distribution and any group size: the sorted rows are
    checkpointed with their partition-local index, and only one row per
    (group, partition) is needed to turn that index into a rank.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in keys + order]
    placed = checkpointed(
        df.repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seq", 33))
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys, "_part")
        .agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(
            *keys, "_part", "_first",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        )
    )
    return (
        join_small(placed, starts, keys + ["_part"], "inner")
        .withColumn(name, F.col("_seq") - F.col("_first") + F.col("_offset") + F.lit(1))
        .drop("_seq", "_part", "_first", "_offset")
    )


def exact_median(df: DataFrame, keys: list[str], value: Column, bins: int = 1 << 16) -> DataFrame:
    """Exact median of a non-negative value per group, as (keys, N, MEDIAN).

    A histogram finds the bin(s) that hold the middle ranks; only the distinct
    values inside them are ordered.  NULLs are ignored.
    """
    v = df.select(*keys, value.alias("_v")).where(F.col("_v").isNotNull())
    v = checkpointed(v)  # one narrow column, read twice
    v = v.withColumn("_bin", F.floor(F.col("_v") / (F.lit(1.0) + F.col("_v")) * F.lit(bins)))
    below = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    histogram = v.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    lower = F.floor((F.col("N") + F.lit(1)) / F.lit(2))
    upper = F.floor((F.col("N") + F.lit(2)) / F.lit(2))
    middle = (
        histogram.withColumn("N", F.sum("_n").over(whole))
        .withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
        .where((F.col("_below") < upper) & (F.col("_below") + F.col("_n") >= lower))
        .select(*keys, "_bin", "N", "_below")
    )
    inner = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        join_small(v, middle, keys + ["_bin"], "inner")
        .groupBy(*keys, "_bin", "N", "_below", "_v").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.col("_below") + F.sum("_n").over(inner))
    )

    def pick(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") >= rank, F.col("_v")))

    return (
        ranked.groupBy(*keys, "N")
        .agg(pick(lower).alias("_lo"), pick(upper).alias("_hi"))
        .select(*keys, F.col("N").cast("long"), ((F.col("_lo") + F.col("_hi")) / F.lit(2.0)).alias("MEDIAN"))
    )
