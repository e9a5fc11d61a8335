"""Phenotype rows and genotype joins shared by the association models."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscan.operators.bounded import join_small
from cohortscan.operators.pheno import complete_cases, zscore
from cohortscan.schemas import SCAN_KEY
from cohortscan.session import checkpointed

BROADCAST_CELLS = 8_000_000
SET = ["DATASET", "OUTCOME"]

RESULT = [
    "MODEL", "DATASET", "OUTCOME", "POS", "A1", "A2", "TERM", "BETA", "SE", "STAT",
    "NEGLOG10P", "P", "N_OBS", "N_GROUP", "N_EVENT", "STATUS",
]


def prepare(
    rows: DataFrame, covariates: list[str], response: list[str], manifest: DataFrame | None = None,
    model: str | None = None, scale: bool = True,
) -> DataFrame:
    """Complete cases with standardised covariates per (DATASET, OUTCOME).

    With a manifest, only its sets are kept and covariates it does not list
    for a set are held at zero there, which leaves them out of that model.
    Covariates that do not vary become zero as well.
    """
    names = [F.col(c).cast("double").alias(c) for c in covariates]
    keep = [c for c in rows.columns if c not in covariates]
    table = rows.select(*keep, *names)
    if manifest is not None:
        specs = manifest.where(F.col("TYPE") == model) if model else manifest
        table = join_small(table, specs.select(*SET, F.col("COV").alias("_cov")), SET, "inner")
        table = table.withColumns(
            {c: F.when(F.array_contains("_cov", c), F.col(c)).otherwise(F.lit(0.0)) for c in covariates}
        ).drop("_cov")
    table = complete_cases(table, response + covariates)
    if scale and covariates:
        # The statistics and the scaled rows both read this; upstream runs once.
        table = checkpointed(table)
        table = zscore(table, covariates, SET)
        table = table.fillna(0.0, subset=covariates)
    return table


def join_genotypes(geno: DataFrame, table: DataFrame) -> DataFrame:
    """Observed dosages with the phenotype rows of their subject.

    The phenotype side is broadcast only when its checkpointed size is small;
    larger ones take a shuffled join on the subject.
    """
    kept = checkpointed(table)
    small = kept.count() * len(kept.columns) <= BROADCAST_CELLS
    observed = geno.where(F.col("DOSAGE").isNotNull())
    return observed.join(F.broadcast(kept) if small else kept, ["DATASET", "IID"], "inner")


def triangle(names: list[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(names, 2))


def sum_products(values: dict[str, Column], weight: Column | None = None) -> Column:
    """Packed upper triangle of sum(w a b) as one array aggregate."""
    w = (lambda x: x) if weight is None else (lambda x: weight * x)
    return F.array(*[F.sum(w(values[a] * values[b])) for a, b in triangle(list(values))])


def result(df: DataFrame, model: str) -> DataFrame:
    """The common result layout."""
    present = df.withColumn("MODEL", F.lit(model))
    fill = {"N_GROUP": "long", "N_EVENT": "long"}
    missing = {c: F.lit(None).cast(t) for c, t in fill.items() if c not in df.columns}
    return present.withColumns(missing).select(*RESULT) if missing else present.select(*RESULT)


def key_schema(df: DataFrame, keys: list[str] | None = None) -> str:
    keys = SCAN_KEY if keys is None else keys
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{k} {types[k]}" for k in keys)
