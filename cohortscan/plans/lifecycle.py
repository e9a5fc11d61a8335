"""End-to-end plans: phenotypes to models, cohort results to graded hits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.models.api import scan
from cohortscan.models.arrays import SubjectArrays
from cohortscan.operators import assoc as A
from cohortscan.operators import ids as I
from cohortscan.operators import manifest as M
from cohortscan.operators import meta as P
from cohortscan.operators import pheno as B
from cohortscan.operators import post as Q
from cohortscan.operators import survival as V
from cohortscan.schemas import TIME_VARYING
from cohortscan.session import checkpointed


@dataclass
class Prepared:
    """Model tables in long outcome form and the manifest of what can be fitted."""

    baseline: DataFrame
    longitudinal: DataFrame
    survival: DataFrame
    manifest: DataFrame


def prepare_phenotypes(
    ids: DataFrame, pheno: DataFrame, components: DataFrame, binary: list[str], continuous: list[str],
    covariates: list[str], rules: I.CohortRules | None = None,
) -> Prepared:
    """All per-model tables of all cohorts from one joined visit table."""
    return prepare_visits(I.join_phenotypes(ids, pheno), components, binary, continuous, covariates, rules)


def prepare_visits(
    visits: DataFrame, components: DataFrame, binary: list[str], continuous: list[str], covariates: list[str],
    rules: I.CohortRules | None = None,
) -> Prepared:
    """The same from visits (DATASET, IID, TSTART, outcomes, covariates) that are joined already."""
    visits = checkpointed(visits)
    if "SEADL" in visits.columns and "SEADL70" not in visits.columns:
        visits = B.derive_seadl70(visits)
    baseline, first = B.build_baseline(visits, components, binary, covariates, rules)
    longitudinal, later = B.build_longitudinal(visits, components, continuous, covariates)
    survival = checkpointed(V.build_survival(visits, binary, covariates))
    varying = B.active_lists(visits, covariates)
    manifest = M.build_manifest(first, later, M.survival_specs(survival, varying))
    return Prepared(baseline, longitudinal, B.attach_components(survival, components), manifest)


def run_manifest(
    geno: DataFrame, prepared: Prepared, covariates: list[str], arrays: SubjectArrays | None = None
) -> DataFrame:
    """Every model of every manifest row over all variants, with a STATUS for each.

    Each model is one scan over all its (DATASET, OUTCOME) sets; covariates
    that the manifest does not list for a set are left out there, and
    components in the tables always take part.  ``arrays`` are the same
    genotypes by subject: with them the iterative models get phenotype rows
    once for 64 variants, and not once for each window of a chromosome.
    """
    manifest = checkpointed(prepared.manifest)
    over_time = B.time_covariate(covariates)
    within = [c for c in over_time if c in TIME_VARYING]
    kind = F.col("KIND")
    single, visits = (prepared.longitudinal.where(kind == k).drop("KIND") for k in ("single", "longitudinal"))
    fitted = geno if arrays is None else arrays
    runs = [
        ("lgsbl", fitted, prepared.baseline, covariates), ("lnsgl", geno, single, over_time), ("lnmxi", geno, visits, over_time),
        ("lnmxs", geno, visits, over_time), ("lncns", geno, visits, within), ("coxhm", fitted, prepared.survival, covariates),
    ]
    return reduce(DataFrame.unionByName, [scan(m, calls, rows, names, manifest) for m, calls, rows, names in runs])


def combine_results(results: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Scan output ready for pooling: fitted, bounded, described, models folded."""
    usable = A.keep_bounded_effects(A.drop_failed(results.where(F.col("STATUS") == "OK")))
    if info is not None:
        named = info.select(
            "DATASET", F.col("SNP").alias("POS"), F.col("A1").alias("INFO_A1"), "ALT_FRQ", "RSQ"
        )
        usable = A.join_info(usable, named, ["DATASET", "POS"])
    return A.fold_models(usable)


def grade(
    results: DataFrame, manifest: DataFrame | None = None, rule: str = "b", gc: bool = False
) -> DataFrame:
    """Pool cohorts, filter, and grade every (variant, test) cell."""
    planned = results if manifest is None else A.fold_models(manifest.withColumnRenamed("TYPE", "MODEL"))
    pooled = P.meta_fixed(results, gc=gc)
    return Q.tiers(P.filter_meta(pooled, P.cohort_counts(planned), rule))
