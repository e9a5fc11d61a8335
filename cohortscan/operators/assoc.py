"""Per-cohort association results: allele orientation, checks and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscan.schemas import WIDE_EFFECT_OUTCOMES


def effect_bound(outcome: Column, usual: float = 5.0, wide: float = 10.0) -> Column:
    """Largest accepted |effect|; wider for the scales that run over many points."""
    return F.when(outcome.isin(*WIDE_EFFECT_OUTCOMES), F.lit(wide)).otherwise(F.lit(usual))


def keep_bounded_effects(
    assoc: DataFrame, outcome: Column | None = None, usual: float = 5.0, wide: float = 10.0
) -> DataFrame:
    outcome = F.col("OUTCOME") if outcome is None else outcome
    return assoc.where(F.abs("BETA") < effect_bound(outcome, usual, wide))


def drop_failed(assoc: DataFrame, column: str = "P") -> DataFrame:
    return assoc.where(F.col(column).isNotNull())


def join_info(assoc: DataFrame, info: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Results with the frequency and quality of their variant.

    ``info`` carries its own A1 as INFO_A1; rows whose effect allele is not
    the one the info describes are dropped for inner joins (a position can
    carry several alleles).  ``how='left'`` keeps every result row.
    """
    joined = assoc.join(info, on, how)
    if how == "inner" and "INFO_A1" in info.columns:
        joined = joined.where(F.col("A1") == F.col("INFO_A1")).drop("INFO_A1")
    return joined


def to_minor_allele(assoc: DataFrame) -> DataFrame:
    """Orient every row to the minor allele: allele pair, effect sign, frequency.

    Which allele is the minor one is unknown without a frequency, so all four
    are NULL there.
    """
    keep, swap = F.col("ALT_FRQ") <= 0.5, F.col("ALT_FRQ") > 0.5
    return assoc.select(
        *[c for c in assoc.columns if c not in ("A1", "A2", "BETA", "ALT_FRQ")],
        F.when(keep, F.col("A1")).when(swap, F.col("A2")).alias("MINOR_ALLELE"),
        F.when(keep, F.col("A2")).when(swap, F.col("A1")).alias("MAJOR_ALLELE"),
        F.when(keep, F.col("BETA")).when(swap, -F.col("BETA")).alias("BETA"),
        F.when(keep, F.col("ALT_FRQ")).when(swap, F.lit(1.0) - F.col("ALT_FRQ")).alias("MAF"),
    )


def fold_models(assoc: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Relabel models so that single-visit cohorts pool with the intercept model.

    A cohort enters the pooled term once: where it has rows of the intercept
    term itself, its rows of a model that would be relabelled to it are left
    out, and of several such models the first in ``renames`` is taken.
    """
    # Models that are pooled under the intercept term.
    renames = renames or {"lnmxi": "lnmxs_intcp", "lnsgl": "lnmxs_intcp"}
    source = [n for n in ("DATASET", "OUTCOME") if n in assoc.columns]
    order = {old: 1 + i for i, old in enumerate(renames)}
    folded, rank = F.col("MODEL"), F.lit(0)
    for old, new in renames.items():
        folded = F.when(F.col("MODEL") == old, F.lit(new)).otherwise(folded)
        rank = F.when(F.col("MODEL") == old, F.lit(order[old])).otherwise(rank)
    named = assoc.withColumns({"_fold": rank, "MODEL": folded})
    first = named.groupBy(*source, "MODEL").agg(F.min("_fold").alias("_first"))
    return named.join(first, [*source, "MODEL"]).where("_fold = _first").select(*assoc.columns)


def swap_alleles(assoc: DataFrame) -> DataFrame:
    """Exchange the two allele columns (result files list them the other way round)."""
    return assoc.withColumns({"A1": F.col("A2"), "A2": F.col("A1")})
