"""One entry point over all association models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.models.arrays import SubjectArrays
from cohortscan.models.cox import cox_scan
from cohortscan.models.linear import conditional_scan, linear_scan, plain_linear_scan
from cohortscan.models.logistic import logistic_scan
from cohortscan.models.mixed import gee_scan, mixed_scan
from cohortscan.models.slope import random_slope_scan
from cohortscan.schemas import PCS

TIME = "YEARfDIAG"


def scan(
    model: str, geno: DataFrame | SubjectArrays, rows: DataFrame, covariates: list[str], manifest: DataFrame | None = None,
    form: str | None = None, scale: bool = True,
) -> DataFrame:
    """Scan every variant of ``geno`` for every (DATASET, OUTCOME) of ``rows``.

    model: lgsbl, lnsgl, coxhm, lnmxi, lnmxs, lncns or slope.  ``form`` picks
    among the three lnmxs fits: ``interaction`` (random intercept, default),
    ``gee`` or ``random_slope``.  Principal components present in ``rows`` are
    always added to the covariates.  lgsbl, coxhm and ``random_slope`` also
    take genotypes by subject.
    """
    extra = [c for c in PCS if c in rows.columns and c not in covariates]
    names = [*covariates, *extra]
    if manifest is not None and extra:
        manifest = manifest.withColumn("COV", F.array_union("COV", F.array(*[F.lit(c) for c in extra])))
    if model == "lgsbl":
        return logistic_scan(geno, rows, names, manifest, scale)
    if model == "lnsgl":
        return linear_scan(geno, rows, names, manifest, scale)
    if model == "coxhm":
        return cox_scan(geno, rows, names, manifest, scale)
    if model == "lnmxi":
        return mixed_scan(geno, rows, names, None, manifest, scale)
    if model == "lncns":
        # Components do not vary within a subject.
        return conditional_scan(geno, rows, TIME, [c for c in covariates if c != TIME], manifest)
    if model == "slope":
        return plain_linear_scan(geno, rows)
    if model == "lnmxs":
        if form == "gee":
            return gee_scan(geno, rows, names, TIME, manifest, scale)
        if form == "random_slope":
            return random_slope_scan(geno, rows, names, TIME, manifest)
        return mixed_scan(geno, rows, names, TIME, manifest, scale)
    raise ValueError(f"unknown model {model}")
