"""Inverse-variance fixed-effect pooling across cohorts and its filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscan.functions.columns import CHI2_MEDIAN, chi2_sf, neglog10_p, two_sided_p
from cohortscan.operators.bounded import join_small
from cohortscan.operators.ordered import exact_median

TEST = ["MODEL", "OUTCOME"]


def genomic_control(assoc: DataFrame, by: list[str]) -> DataFrame:
    """Inflate SE by sqrt(lambda) per input set; lambda below one is left alone."""
    z2 = (F.col("BETA") / F.col("SE")) * (F.col("BETA") / F.col("SE"))
    lam = exact_median(assoc, by, z2).select(
        *by, F.greatest(F.col("MEDIAN") / F.lit(CHI2_MEDIAN), F.lit(1.0)).alias("LAMBDA")
    )
    return (
        join_small(assoc, lam, by, "inner")
        .withColumn("SE", F.col("SE") * F.sqrt("LAMBDA"))
        .drop("LAMBDA")
    )


def align_alleles(assoc: DataFrame) -> DataFrame:
    """Effects of the alphabetically first allele, so cohorts can be added up."""
    flip = F.col("A1") > F.col("A2")
    out = {
        "Allele1": F.least("A1", "A2"),
        "Allele2": F.greatest("A1", "A2"),
        "BETA": F.when(flip, -F.col("BETA")).otherwise(F.col("BETA")),
    }
    if "ALT_FRQ" in assoc.columns:
        out["ALT_FRQ"] = F.when(flip, F.lit(1.0) - F.col("ALT_FRQ")).otherwise(F.col("ALT_FRQ"))
    return assoc.withColumns(out)


def _direction(members: Column) -> Column:
    """One character per cohort of the test: + - 0, or ? where it has no result."""
    def character(cohort: Column) -> Column:
        own = F.filter("_signs", lambda x: x["DATASET"] == cohort)
        sign = F.array_max(F.transform(own, lambda x: x["sign"]))
        return F.when(sign > 0, "+").when(sign < 0, "-").when(sign == 0, "0").otherwise("?")

    return F.array_join(F.transform(members, character), "")


def meta_fixed(assoc: DataFrame, by: list[str] | None = None, gc: bool = False) -> DataFrame:
    """Pool (by..., DATASET, POS, A1, A2, BETA, SE[, ALT_FRQ]) over DATASET.

    Every output is a function of sums that combine map-side and of the signs
    of a marker's cohorts.  A cohort counts once for a marker of a test: choose
    one result for each before pooling (``fold_models``); ``repeated_inputs``
    lists those that have several.
    """
    by = TEST if by is None else by
    usable = assoc.where(F.col("BETA").isNotNull() & (F.col("SE") > 0))
    if gc:
        usable = genomic_control(usable, by + ["DATASET"])
    aligned = align_alleles(usable).withColumn("_w", F.lit(1.0) / (F.col("SE") * F.col("SE")))
    has_frequency = "ALT_FRQ" in assoc.columns
    f = F.col("ALT_FRQ") if has_frequency else F.lit(None).cast("double")

    # The cohorts that take part in each test, in alphabetic order.
    members = aligned.groupBy(*by).agg(F.array_sort(F.collect_set("DATASET")).alias("_cohorts"))
    w, b = F.col("_w"), F.col("BETA")
    sums = aligned.groupBy(*by, "POS", "Allele1", "Allele2").agg(
        F.sum(w).alias("_sw"),
        F.sum(w * b).alias("_swb"),
        F.sum(w * b * b).alias("_swbb"),
        F.count(F.lit(1)).alias("_k"),
        F.sum(F.when(f.isNotNull(), w)).alias("_swk"),
        F.sum(w * f).alias("_swf"),
        F.sum(w * f * f).alias("_swff"),
        F.min(f).alias("MinFreq"),
        F.max(f).alias("MaxFreq"),
        F.collect_list(F.struct("DATASET", F.signum("BETA").alias("sign"))).alias("_signs"),
    )
    effect = F.col("_swb") / F.col("_sw")
    freq = F.col("_swf") / F.col("_swk")
    df = F.col("_k") - F.lit(1)
    spread = F.col("_swbb") - F.col("_swb") * F.col("_swb") / F.col("_sw")
    q = F.when(df > 0, F.greatest(spread, F.lit(0.0))).otherwise(F.lit(0.0))
    sums = join_small(sums, members, by, "inner") if by else sums.crossJoin(F.broadcast(members))  # one row
    direction = _direction(F.col("_cohorts"))
    pooled = sums.select(
        *by, "POS", "Allele1", "Allele2",
        freq.alias("Freq1"),
        F.when(
            F.col("MaxFreq") > F.col("MinFreq"),
            F.sqrt(F.greatest(F.col("_swff") / F.col("_swk") - freq * freq, F.lit(0.0))),
        ).when(F.col("MaxFreq").isNotNull(), F.lit(0.0)).alias("FreqSE"),
        "MinFreq", "MaxFreq",
        effect.alias("Effect"),
        (F.lit(1.0) / F.sqrt("_sw")).alias("StdErr"),
        (F.col("_swb") / F.sqrt("_sw")).alias("Z"),
        direction.alias("Direction"),
        F.when(q > df, F.lit(100.0) * (q - df) / q).otherwise(F.lit(0.0)).alias("HetISq"),
        q.alias("HetChiSq"),
        df.cast("long").alias("HetDf"),
    )
    return pooled.withColumns(
        {
            "P": two_sided_p(F.col("Z")),
            "NEGLOG10P": neglog10_p(F.col("Z")),
            "HetPVal": F.least(
                F.coalesce(chi2_sf(F.col("HetChiSq"), F.col("HetDf")), F.lit(1.0)), F.lit(1.0)
            ),
        }
    )


def repeated_inputs(assoc: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., DATASET, POS, alleles, N) that a pooling would count more than once."""
    by = TEST if by is None else by
    usable = align_alleles(assoc.where(F.col("BETA").isNotNull() & (F.col("SE") > 0)))
    keys = [*by, "DATASET", "POS", "Allele1", "Allele2"]
    return usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("N")).where("N > 1")


def cohort_counts(manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of cohorts planned per test and its integer half.

    Distinct first, so a test named by a third of the rows is counted from
    its few distinct cohorts.
    """
    by = TEST if by is None else by
    return (
        manifest.select(*by, "DATASET").distinct().groupBy(*by)
        .agg(F.count(F.lit(1)).alias("N_COHORTS"))
        .withColumn("THRESHOLD", F.floor(F.col("N_COHORTS") / F.lit(2)).cast("long"))
    )


def filter_meta(
    meta: DataFrame, counts: DataFrame, rule: str = "c", by: list[str] | None = None
) -> DataFrame:
    """Keep markers seen in enough cohorts and not too heterogeneous.

    a: HetDf above half the cohorts; b: at least half; c: b plus HetDf > 0,
    frequency spread below 0.15 and a common variant.  HetISq < 80 always.
    """
    by = TEST if by is None else by
    joined = join_small(meta, counts, by, "inner").where(F.col("HetISq") < 80)
    if rule == "a":
        kept = joined.where(F.col("HetDf") > F.col("THRESHOLD"))
    elif rule in ("b", "c"):
        kept = joined.where(F.col("HetDf") >= F.col("THRESHOLD"))
    else:
        raise ValueError(f"unknown rule {rule}")
    if rule == "c":
        kept = kept.where(
            (F.col("HetDf") > 0)
            & (F.col("MaxFreq") - F.col("MinFreq") < 0.15)
            & (F.col("Freq1") > 0.05)
            & (F.col("Freq1") < 0.95)
        )
    return kept.drop("N_COHORTS", "THRESHOLD")


def to_pooled_layout(meta: DataFrame) -> DataFrame:
    """The fifteen-column export layout of a pooled table."""
    return meta.select(
        F.col("POS").alias("MarkerName"), "Allele1", "Allele2", "Freq1", "FreqSE", "MinFreq",
        "MaxFreq", "Effect", "StdErr", F.col("P").alias("P-value"), "Direction", "HetISq",
        "HetChiSq", "HetDf", "HetPVal",
    )
