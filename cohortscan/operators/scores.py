"""Polygenic and carrier scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.operators.pheno import zscore
from cohortscan.schemas import CARRIER_WEIGHTS, WEIGHTS
from cohortscan.session import checkpointed


def _weighted(geno: DataFrame, weights: DataFrame) -> DataFrame:
    """Hard calls counted as copies of the effect allele, with their weight."""
    joined = geno.join(weights, "POS", "inner")
    copies = F.when(F.col("EFFECT_ALLELE") == F.col("A1"), F.col("GT")).when(
        F.col("EFFECT_ALLELE") == F.col("A2"), F.lit(2) - F.col("GT")
    )
    return joined.withColumn("COPIES", copies).where(F.col("COPIES").isNotNull())


def polygenic_score(geno: DataFrame, weights: DataFrame, standardise: bool = True) -> DataFrame:
    """Mean weight per observed allele and subject, standardised per cohort."""
    score = _weighted(geno, weights).groupBy("DATASET", "IID").agg(
        (F.sum(F.col("COPIES") * F.col("WEIGHT")) / (F.lit(2.0) * F.count(F.lit(1)))).alias("SCORE")
    )
    # Mean and deviation are read from the scores, not from the genotypes again.
    return zscore(checkpointed(score), ["SCORE"], ["DATASET"]) if standardise else score


def carrier_weights(spark) -> DataFrame:
    return spark.createDataFrame(CARRIER_WEIGHTS, WEIGHTS)


def carrier_score(geno: DataFrame, weights: DataFrame) -> DataFrame:
    """Coded sum over the carrier variants and its 0/1 form."""
    summed = _weighted(geno, weights).groupBy("DATASET", "IID").agg(
        F.sum(F.col("COPIES") * F.col("WEIGHT")).alias("CODED_SUM")
    )
    return summed.withColumn("CARRIER", (F.col("CODED_SUM") > 0).cast("int"))


def as_variants(scores: DataFrame, name: str, column: str = "SCORE") -> DataFrame:
    """Scores in dosage form, so a scan treats them as one more predictor."""
    return scores.select(
        "DATASET", "IID", F.lit(name).alias("POS"), F.lit("A").alias("A1"), F.lit("N").alias("A2"),
        F.col(column).cast("double").alias("DOSAGE"),
    )


def unscored_variants(weights: DataFrame, geno: DataFrame) -> DataFrame:
    """Weighted variants that no genotype row covers."""
    return weights.join(geno.select("POS").distinct(), "POS", "left_anti")
