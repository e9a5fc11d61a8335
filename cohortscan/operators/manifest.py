"""Model manifest (TYPE, DATASET, OUTCOME, COV) and run completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOB = ["TYPE", "DATASET", "OUTCOME"]


def build_manifest(*specs: DataFrame) -> DataFrame:
    out = specs[0].select(*JOB, "COV")
    for s in specs[1:]:
        out = out.unionByName(s.select(*JOB, "COV"))
    return out


def survival_specs(table: DataFrame, covariates: DataFrame) -> DataFrame:
    """Manifest rows of the survival sets; ``covariates`` is (DATASET, COV)."""
    sets = table.select("DATASET", "OUTCOME").distinct()
    return sets.join(covariates, "DATASET").select(F.lit("coxhm").alias("TYPE"), "DATASET", "OUTCOME", "COV")


def to_text(manifest: DataFrame) -> DataFrame:
    """One ``TYPE;DATASET;OUTCOME;COV`` line per row."""
    return manifest.select(
        F.concat_ws(";", *JOB, F.array_join("COV", ",")).alias("value")
    )


def parse_manifest(lines: DataFrame, sep: str = ";") -> DataFrame:
    """Text lines to manifest rows; the header line is skipped."""
    part = F.split("value", sep)
    return lines.where(~F.col("value").startswith(f"TYPE{sep}")).select(
        part[0].alias("TYPE"), part[1].alias("DATASET"), part[2].alias("OUTCOME"),
        F.split(F.get(part, F.lit(3)), ",").alias("COV"),
    )


def dataset_lists(manifest: DataFrame) -> DataFrame:
    """Datasets of each test as one comma list."""
    return (
        manifest.select("TYPE", "OUTCOME", "DATASET").distinct().groupBy("TYPE", "OUTCOME")
        .agg(F.array_join(F.array_sort(F.collect_list("DATASET")), ",").alias("DATASETS"))
    )


def formula(model: str, outcome: str, covariates: list[str], variant: str = "snp") -> str:
    """Text of the model a manifest row stands for (for logs and reports)."""
    right = " + ".join([variant, *covariates])
    if model == "lgsbl":
        return f"I({outcome} == 2) ~ {right}"
    if model == "coxhm":
        return f"Surv(TSTART, TSTOP, {outcome} == 1) ~ {right}"
    if model == "lnmxi":
        return f"{outcome} ~ {right} + (1 | IID)"
    if model == "lnmxs":
        return f"{outcome} ~ {right} + {variant}:YEARfDIAG + (1 | IID)"
    if model == "lncns":
        return f"{outcome} ~ 0 + {variant}:YEARfDIAG + " + " + ".join(covariates)
    return f"{outcome} ~ {right}"


def missing_jobs(manifest: DataFrame, results: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Planned jobs without any result."""
    on = JOB if on is None else on
    return manifest.select(*on).distinct().join(results.select(*on).distinct(), on, "left_anti")


def unplanned_jobs(manifest: DataFrame, results: DataFrame, on: list[str] | None = None) -> DataFrame:
    return missing_jobs(results, manifest, on)


def audit_jobs(manifest: DataFrame, results: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Symmetric difference of planned and finished; empty when they cancel out."""
    missing = missing_jobs(manifest, results, on).withColumn("SIDE", F.lit("planned"))
    extra = unplanned_jobs(manifest, results, on).withColumn("SIDE", F.lit("finished"))
    return missing.unionByName(extra)
