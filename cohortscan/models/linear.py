"""Linear scans: covariate-adjusted, plain, and within-subject (conditional)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.functions.columns import neglog10_p, two_sided_p
from cohortscan.functions.numeric import active_inverse, symmetric, t_neglog10_p
from cohortscan.models.design import SET, join_genotypes, key_schema, prepare, result, sum_products
from cohortscan.operators.bounded import attach_stats, join_small
from cohortscan.operators.contrast import demean
from cohortscan.schemas import SCAN_KEY, VARIANT_KEY
from cohortscan.session import checkpointed

STATUS_OK, NO_VARIANCE, NO_CONVERGE = "OK", "NO_VARIANCE", "NO_CONVERGE"


def linear_scan(
    geno: DataFrame, rows: DataFrame, covariates: list[str], manifest: DataFrame | None = None,
    scale: bool = True,
) -> DataFrame:
    """y ~ dosage + covariates for every variant (model lnsgl).

    One pass: sums of products per variant combine map-side, and a small
    batch solve turns each packed matrix into an estimate.
    """
    table = prepare(rows, covariates, ["Y"], manifest, "lnsgl", scale)
    table = attach_stats(table, SET, _m=F.avg("Y")).withColumn("Y", F.col("Y") - F.col("_m")).drop("_m")
    joined = join_genotypes(geno, table.select(*SET, "IID", "Y", *covariates))
    values = {"1": F.lit(1.0), "S": F.col("DOSAGE"), **{c: F.col(c) for c in covariates}, "Y": F.col("Y")}
    p = len(values)
    sums = joined.groupBy(*SCAN_KEY).agg(sum_products(values).alias("M"), F.count(F.lit(1)).alias("N_OBS"))
    schema = key_schema(sums) + ", BETA double, SE double, STAT double, DF double, N_OBS long, STATUS string"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            full = symmetric(np.stack(batch["M"].to_numpy()), p)
            xy, yy = full[:, :-1, -1], full[:, -1, -1]
            inverse, keep = active_inverse(full[:, :-1, :-1])
            beta = np.einsum("vij,vj->vi", inverse, xy)
            df = batch["N_OBS"].to_numpy() - keep.sum(axis=1)
            rss = np.maximum(yy - np.einsum("vi,vi->v", beta, xy), 0.0)
            ok = keep[:, 1] & (df > 0)
            se = np.sqrt(rss / np.where(df > 0, df, 1) * inverse[:, 1, 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                stat = beta[:, 1] / se
            out = batch[SCAN_KEY].copy()
            out["BETA"], out["SE"] = np.where(ok, beta[:, 1], np.nan), np.where(ok, se, np.nan)
            out["STAT"], out["DF"] = np.where(ok, stat, np.nan), df.astype(float)
            out["N_OBS"], out["STATUS"] = batch["N_OBS"], np.where(ok, STATUS_OK, NO_VARIANCE)
            yield out

    fits = sums.mapInPandas(solve, schema)
    fits = fits.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("BETA", "SE", "STAT")})
    tested = fits.withColumn("NEGLOG10P", t_neglog10_p("STAT", "DF"))
    return result(
        tested.withColumns({"P": F.pow(F.lit(10.0), -F.col("NEGLOG10P")), "TERM": F.lit("snp"), "N_GROUP": F.col("N_OBS")}),
        "lnsgl",
    )


def plain_linear_scan(geno: DataFrame, rows: DataFrame, model: str = "slope") -> DataFrame:
    """y ~ dosage without covariates, from the built-in regression aggregates."""
    joined = join_genotypes(geno, rows.where(F.col("Y").isNotNull()).select(*SET, "IID", "Y"))
    y, s = F.col("Y"), F.col("DOSAGE")
    sums = joined.groupBy(*SCAN_KEY).agg(
        F.regr_slope(y, s).alias("BETA"), F.regr_sxx(y, s).alias("_sxx"), F.regr_syy(y, s).alias("_syy"),
        F.regr_sxy(y, s).alias("_sxy"), F.count(F.lit(1)).alias("N_OBS"),
    )
    df = (F.col("N_OBS") - 2).cast("double")
    rss = F.greatest(F.col("_syy") - F.col("BETA") * F.col("_sxy"), F.lit(0.0))
    ok = (F.col("_sxx") > 0) & (df > 0)
    fits = sums.withColumn("SE", F.when(ok, F.sqrt(F.try_divide(rss, df * F.col("_sxx"))))).withColumns(
        {"BETA": F.when(ok, F.col("BETA")), "STAT": F.try_divide(F.col("BETA"), F.col("SE")),
         "STATUS": F.when(ok, STATUS_OK).otherwise(NO_VARIANCE), "TERM": F.lit("snp")}
    )
    tested = fits.withColumn("NEGLOG10P", t_neglog10_p("STAT", df))
    return result(
        tested.withColumns({"P": F.pow(F.lit(10.0), -F.col("NEGLOG10P")), "N_GROUP": F.col("N_OBS")}), model
    )


def conditional_scan(
    geno: DataFrame, rows: DataFrame, time: str = "YEARfDIAG", others: list[str] | None = None,
    manifest: DataFrame | None = None,
) -> DataFrame:
    """Within-subject slope effect of every variant (model lncns).

    Rows are demeaned per subject, so a dosage enters only through
    dosage x time.  Per subject three kinds of sums remain (time-time,
    time-covariate, time-response); per variant they are weighted by the
    dosage and its square.  A missing dosage takes the variant's mean, added
    afterwards from the sums over the subjects that miss it.  Subjects without
    any genotype row take no part.  With a manifest, only its sets are kept and
    a covariate that it does not list for a set is held at zero there.
    """
    others = others or []
    x = [time, *others]
    if manifest is not None:  # time is the effect itself, listed or not
        manifest = manifest.withColumn("COV", F.array_union("COV", F.array(F.lit(time))))
    planned = prepare(rows, x, ["Y"], manifest, "lncns", scale=False)
    genotyped = geno.select("DATASET", "IID").distinct()
    kept = planned.join(genotyped, ["DATASET", "IID"], "left_semi").select(
        *SET, "IID", *[F.col(c).cast("double").alias(c) for c in ["Y", *x]])
    inner = checkpointed(demean(kept, SET + ["IID"], ["Y", *x]))
    subject = inner.groupBy(*SET, "IID").agg(
        F.sum(F.col(time) * F.col(time)).alias("_tt"),
        *[F.sum(F.col(time) * F.col(c)).alias(f"_t_{c}") for c in x],
        F.sum(F.col(time) * F.col("Y")).alias("_ty"),
        (F.count(F.lit(1)) - 1).alias("_rows"),
    )
    values = {c: F.col(c) for c in [*x, "Y"]}
    whole = inner.groupBy(*SET).agg(sum_products(values).alias("_xx"))
    sizes = subject.groupBy(*SET).agg(F.sum("_rows").alias("N_OBS"), F.count(F.lit(1)).alias("N_GROUP"))

    with_missing = geno.withColumns({"_seen": F.col("DOSAGE").isNotNull(), "DOSAGE": F.coalesce("DOSAGE", F.lit(0.0))})
    joined = join_genotypes(with_missing, subject)
    s, absent = F.col("DOSAGE"), F.when(~F.col("_seen"), 1.0).otherwise(0.0)
    linear = [f"_t_{c}" for c in x] + ["_ty"]
    sums = joined.groupBy(*SCAN_KEY).agg(
        F.sum(s * s * F.col("_tt")).alias("_ss"), F.sum(absent * F.col("_tt")).alias("_ss0"),
        *[F.sum(s * F.col(c)).alias(f"{c}_s") for c in linear],
        *[F.sum(absent * F.col(c)).alias(f"{c}_0") for c in linear],
    )
    means = geno.groupBy("DATASET", *VARIANT_KEY).agg(F.avg("DOSAGE").alias("_m"))
    filled = sums.join(means, ["DATASET", *VARIANT_KEY], "inner").select(
        *SCAN_KEY, (F.col("_ss") + F.col("_m") * F.col("_m") * F.col("_ss0")).alias("_ss"),
        F.array(*[F.col(f"{c}_s") + F.col("_m") * F.col(f"{c}_0") for c in linear]).alias("_sx"),
    )
    ready = join_small(join_small(filled, whole, SET, "inner"), sizes, SET, "inner")
    k = len(x)
    schema = key_schema(ready) + ", BETA double, SE double, N_OBS long, N_GROUP long"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            full = symmetric(np.stack(batch["_xx"].to_numpy()), k + 1)
            sx, ss = np.stack(batch["_sx"].to_numpy()), batch["_ss"].to_numpy()
            inverse, used = active_inverse(full[:, :k, :k])
            xy = full[:, :k, k]
            project = np.einsum("vij,vj->vi", inverse, sx[:, :k])
            residual = ss - np.einsum("vi,vi->v", project, sx[:, :k])
            product = sx[:, k] - np.einsum("vi,vi->v", project, xy)
            rss0 = full[:, k, k] - np.einsum("vi,vij,vj->v", xy, inverse, xy)
            ok = residual > 1e-10 * np.maximum(ss, 1e-300)
            safe = np.where(ok, residual, 1.0)
            beta = product / safe
            # Covariates in use, and two more for the intercept and the effect itself.
            df = batch["N_OBS"].to_numpy() - used.sum(axis=1) - 2
            sigma = (rss0 - beta * beta * safe) / np.where(df > 0, df, 1)
            ok &= df > 0
            out = batch[SCAN_KEY].copy()
            out["BETA"] = np.where(ok, beta, np.nan)
            out["SE"] = np.where(ok & (sigma > 0), np.sqrt(np.maximum(sigma, 0.0) / safe), np.nan)
            out["N_OBS"], out["N_GROUP"] = batch["N_OBS"], batch["N_GROUP"]
            yield out

    fits = ready.mapInPandas(solve, schema)
    fits = fits.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("BETA", "SE")})
    z = F.try_divide(F.col("BETA"), F.col("SE"))
    return result(
        fits.withColumns(
            {"STAT": z, "NEGLOG10P": neglog10_p(z), "P": two_sided_p(z), "TERM": F.lit("snp:time"),
             "STATUS": F.when(z.isNotNull(), STATUS_OK).otherwise(NO_VARIANCE)}
        ),
        "lncns",
    )
