"""Matching genotype sample ids to clinical ids across cohorts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CohortRules:
    """Which cohorts deviate from ``IID = ID_ID``.

    Fixed values: the cohort names are data values of the phenotype file.
    """

    upper_second_part: tuple[str, ...] = ("PARKFIT",)
    linked: str = "OSLO"
    paired: str = "HBS"
    shared: dict[str, str] = field(
        default_factory=lambda: {"DIGPD_neuroX": "DIGPD", "DIGPD_chip": "DIGPD"}
    )
    plain_eigenvector_ids: tuple[str, ...] = ("HBS", "OSLO", "PDBP", "PPMI")
    without_baseline: tuple[str, ...] = ("OSLO",)


def plain_ids(samples: DataFrame, rules: CohortRules) -> DataFrame:
    special = [rules.linked, rules.paired, *rules.shared]
    part = lambda n: F.split_part(F.col("IID"), F.lit("_"), F.lit(n))
    return samples.where(~F.col("DATASET").isin(special)).select(
        "DATASET", "IID",
        F.when(F.col("DATASET").isin(*rules.upper_second_part), F.upper(part(2)))
        .otherwise(part(1)).alias("ID"),
        F.col("DATASET").alias("COHORT"),
    )


def linked_ids(samples: DataFrame, linked: DataFrame, rules: CohortRules) -> DataFrame:
    """Cohort with its own genotype-to-clinical table, genotyped samples only."""
    return (
        linked.select(
            F.lit(rules.linked).alias("DATASET"), F.concat_ws("_", "FID", "IID").alias("IID"),
            F.col("Clincal_ID").alias("ID"),
        )
        .join(samples, ["DATASET", "IID"], "left_semi")
        .withColumn("COHORT", F.col("DATASET"))
    )


def paired_ids(samples: DataFrame, pairs: DataFrame, rules: CohortRules) -> DataFrame:
    """Cohort matched through duplicate genotypes; either column can hold the sample."""
    first_is_sample = F.contains(F.col("IID1"), F.lit(rules.paired))
    return (
        pairs.select(
            F.lit(rules.paired).alias("DATASET"),
            F.when(first_is_sample, F.col("IID1")).otherwise(F.col("IID2")).alias("IID"),
            F.when(first_is_sample, F.col("IID2")).otherwise(F.col("IID1")).alias("ID"),
        )
        .join(samples, ["DATASET", "IID"], "left_semi")
        .withColumn("COHORT", F.col("DATASET"))
    )


def shared_cohort_ids(samples: DataFrame, rules: CohortRules) -> DataFrame:
    """Datasets that are two chips of one cohort."""
    cohort = F.create_map(*[F.lit(x) for kv in rules.shared.items() for x in kv])
    return samples.where(F.col("DATASET").isin(*rules.shared)).select(
        "DATASET", "IID", F.split_part(F.col("IID"), F.lit("_"), F.lit(1)).alias("ID"),
        F.element_at(cohort, F.col("DATASET")).alias("COHORT"),
    )


def map_ids(
    samples: DataFrame, linked: DataFrame, pairs: DataFrame, rules: CohortRules | None = None
) -> DataFrame:
    """(DATASET, IID, ID, COHORT) for every sample that has a clinical id."""
    rules = rules or CohortRules()
    return (
        plain_ids(samples, rules)
        .unionByName(linked_ids(samples, linked, rules))
        .unionByName(paired_ids(samples, pairs, rules))
        .unionByName(shared_cohort_ids(samples, rules))
    )


def phenotype_ids(pheno: DataFrame) -> DataFrame:
    return pheno.select(F.col("STUDY_NAME").alias("COHORT"), "ID").distinct()


def audit_ids(ids: DataFrame, pheno: DataFrame) -> DataFrame:
    """Samples without a clinical record; empty when all is well."""
    return ids.join(phenotype_ids(pheno), ["COHORT", "ID"], "left_anti")


def join_phenotypes(ids: DataFrame, pheno: DataFrame, how: str = "inner") -> DataFrame:
    renamed = pheno.withColumnRenamed("STUDY_NAME", "COHORT")
    return ids.join(renamed, ["COHORT", "ID"], how)


def eigenvector_ids(vectors: DataFrame, rules: CohortRules | None = None) -> DataFrame:
    """Doubled ids (``FID_FID``) as in the imputed files, except in named cohorts."""
    rules = rules or CohortRules()
    plain = F.col("DATASET").isin(*rules.plain_eigenvector_ids)
    double = lambda c: F.when(plain, F.col(c)).otherwise(F.concat_ws("_", c, c))
    return vectors.withColumns({"FID": double("FID"), "IID": double("IID")})
