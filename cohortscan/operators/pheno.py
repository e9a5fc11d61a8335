"""Baseline and longitudinal phenotype tables for all cohorts in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.operators.bounded import attach_stats, join_small
from cohortscan.operators.ids import CohortRules
from cohortscan.schemas import MIN_EVENTS


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values are NULL only; a NaN would poison every average."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def derive_seadl70(df: DataFrame) -> DataFrame:
    return df.withColumn("SEADL70", (F.col("SEADL") <= 70).cast("int"))


def case_coding(df: DataFrame, outcomes: list[str]) -> DataFrame:
    """0 missing, 1 control, 2 case."""
    return df.withColumns({c: F.coalesce(F.col(c) + F.lit(1), F.lit(0)) for c in outcomes})


def pedigree_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "FID": F.col("IID"), "FATID": F.lit(0), "MATID": F.lit(0),
            "SEX": (F.lit(1) + F.col("FEMALE")).cast("int"),
        }
    )


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in a stated order, by a combining aggregate."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in order + [c for c in rest if c not in order]])
    return df.groupBy(*keys).agg(F.min(packed).alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def one_row_per_visit(visits: DataFrame, keys: list[str]) -> DataFrame:
    """One row per subject and day; ties keep the greatest row."""
    rest = [c for c in visits.columns if c not in keys]
    return visits.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in visits.columns]
    )


def baseline(visits: DataFrame, rules: CohortRules | None = None) -> DataFrame:
    """Rows at day 0; the first visit within a year of it in cohorts without a day 0."""
    rules = rules or CohortRules()
    loose = F.col("DATASET").isin(*rules.without_baseline)
    clean = visits.where((F.col("TSTART") == 0) & ~loose)
    near = visits.where(loose & (F.col("TSTART") > -365) & (F.col("TSTART") < 365))
    return clean.unionByName(first_rows(near, ["DATASET", "IID"], ["TSTART"]))


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(how="any", subset=columns)


def unpivot_columns(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    same = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return same.unpivot(ids, columns, name, value)


def covariate_variance(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., NAME, VARIANCE): sample variance of each column, NULLs ignored.

    All columns come from one aggregate row per cohort, then transposed.
    """
    by = ["DATASET"] if by is None else by
    wide = df.groupBy(*by).agg(*[F.var_samp(c).alias(c) for c in columns])
    return unpivot_columns(wide, by, columns, "NAME", "VARIANCE")


def active_columns(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Columns that vary within a cohort."""
    return covariate_variance(df, columns, by).where(F.col("VARIANCE") > 0)


def active_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """(DATASET, COV): sorted varying columns; empty where none varies."""
    varies = F.when(F.col("VARIANCE") > 0, F.col("NAME"))
    return covariate_variance(df, columns).groupBy("DATASET").agg(
        F.array_sort(F.collect_list(varies)).alias("COV")
    )


def outcome_case_counts(coded: DataFrame, outcomes: list[str]) -> DataFrame:
    """(DATASET, OUTCOME, N_CASES) of case-coded outcomes."""
    wide = coded.groupBy("DATASET").agg(
        *[F.sum(F.when(F.col(c) == 2, 1).otherwise(0)).alias(c) for c in outcomes]
    )
    long = unpivot_columns(wide, ["DATASET"], outcomes, "OUTCOME", "N_CASES")
    return long.withColumn("N_CASES", F.col("N_CASES").cast("long"))


def frequent_outcomes(coded: DataFrame, outcomes: list[str], more_than: int = MIN_EVENTS) -> DataFrame:
    return outcome_case_counts(coded, outcomes).where(F.col("N_CASES") > more_than)


def longitudinal_outcomes(visits: DataFrame, outcomes: list[str]) -> DataFrame:
    """(DATASET, OUTCOME, MAX_FOLLOW_UP, KIND) for outcomes that vary in a cohort.

    KIND is ``longitudinal`` when any subject has a later observation.
    """
    later = F.col("TSTART") > 0
    per_subject = visits.groupBy("DATASET", "IID").agg(
        *[F.count(F.when(later, F.col(c))).alias(c) for c in outcomes]
    )
    per_cohort = per_subject.groupBy("DATASET").agg(*[F.max(c).alias(c) for c in outcomes])
    counts = unpivot_columns(per_cohort, ["DATASET"], outcomes, "OUTCOME", "MAX_FOLLOW_UP")
    varying = active_columns(visits, outcomes).select("DATASET", F.col("NAME").alias("OUTCOME"))
    return counts.join(varying, ["DATASET", "OUTCOME"], "left_semi").select(
        "DATASET", "OUTCOME", F.col("MAX_FOLLOW_UP").cast("long").alias("MAX_FOLLOW_UP"),
        F.when(F.col("MAX_FOLLOW_UP") > 0, "longitudinal").otherwise("single").alias("KIND"),
    )


def zscore(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Standardise columns over all retained rows of each group; constant ones become NULL."""
    stats = {}
    for c in columns:
        stats[f"_mean_{c}"] = F.avg(c)
        stats[f"_sd_{c}"] = F.stddev_samp(c)
    scaled = attach_stats(df, by, **stats)
    return scaled.withColumns(
        {
            c: F.when(F.col(f"_sd_{c}") > 0, (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}"))
            for c in columns
        }
    ).drop(*stats)


def time_covariate(columns: list[str]) -> list[str]:
    """Covariate names of models over visits: years at baseline become years at visit."""
    return ["YEARfDIAG" if c == "BLDfDIAG" else c for c in columns]


def columns_like(df: DataFrame, prefixes: list[str]) -> list[str]:
    return [c for c in df.columns if any(c.startswith(p) for p in prefixes)]


def attach_components(df: DataFrame, components: DataFrame) -> DataFrame:
    """Principal components by sample, one row per sample first."""
    keys = [c for c in ("DATASET", "IID") if c in components.columns]
    names = [c for c in components.columns if c not in keys + ["FID"]]
    unique = first_rows(components.select(*keys, *names), keys, names[:1])
    return df.join(unique, keys, "left")


def join_covariates(pheno: DataFrame, covariates: DataFrame) -> DataFrame:
    """Phenotype rows of samples that have covariates, matched on both ids."""
    return pheno.join(covariates, ["FID", "IID"])


def build_baseline(
    visits: DataFrame, components: DataFrame, binary: list[str], covariates: list[str],
    rules: CohortRules | None = None, more_than: int = MIN_EVENTS,
) -> tuple[DataFrame, DataFrame]:
    """Baseline case/control rows in long outcome form, and their manifest rows."""
    rows = pedigree_columns(case_coding(baseline(visits, rules), binary))
    kept = frequent_outcomes(rows, binary, more_than)
    keep = ["FID", "IID", "FATID", "MATID", "SEX"] + covariates
    long = unpivot_columns(rows, ["DATASET"] + keep, binary, "OUTCOME", "Y").withColumn(
        "Y", F.col("Y").cast("int")
    )
    table = attach_components(join_small(long, kept.select("DATASET", "OUTCOME"), ["DATASET", "OUTCOME"], "left_semi"), components)
    names = active_lists(rows, covariates)
    specs = kept.join(names, "DATASET").select(F.lit("lgsbl").alias("TYPE"), "DATASET", "OUTCOME", "COV")
    return table, specs


def build_longitudinal(
    visits: DataFrame, components: DataFrame, continuous: list[str], covariates: list[str],
) -> tuple[DataFrame, DataFrame]:
    """Visit rows of continuous outcomes in long form, and their manifest rows.

    Single-visit outcomes keep only day 0 and run as a plain linear model.
    """
    names = time_covariate(covariates)
    kinds = longitudinal_outcomes(visits, continuous)
    rows = pedigree_columns(visits)
    keep = ["FID", "IID", "FATID", "MATID", "SEX", "TSTART"] + names
    long = unpivot_columns(rows, ["DATASET"] + keep, continuous, "OUTCOME", "Y")
    tagged = join_small(long, kinds.select("DATASET", "OUTCOME", "KIND"), ["DATASET", "OUTCOME"], "inner")
    table = attach_components(
        tagged.where((F.col("KIND") == "longitudinal") | (F.col("TSTART") == 0)), components
    )
    varying = active_lists(visits, names)
    models = F.when(F.col("KIND") == "single", F.array(F.lit("lnsgl"))).otherwise(
        F.array(F.lit("lnmxi"), F.lit("lnmxs"), F.lit("lncns"))
    )
    within = F.filter("COV", lambda c: c.isin("YEARfDIAG", "DOPA", "AGONIST"))
    specs = kinds.join(varying, "DATASET").select(
        F.explode(models).alias("TYPE"), "DATASET", "OUTCOME", "COV"
    ).withColumn("COV", F.when(F.col("TYPE") == "lncns", within).otherwise(F.col("COV")))
    return table, specs
