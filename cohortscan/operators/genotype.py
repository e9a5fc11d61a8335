"""Variant quality control, selection and genotype layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscan.functions.columns import base_pair, chromosome, position_range
from cohortscan.operators.ordered import global_rank, ordinal
from cohortscan.schemas import EXCLUDED_REGIONS, REGIONS, VARIANT_KEY

BLOCK_VARIANTS = 20_000
BLOCK_SAMPLES = 4_096
BIN = 1_000_000

# Fixed values: (minor allele frequency, imputation quality) presets.
QC_PRESETS = {"wide": (0.001, 0.3), "strict": (0.05, 0.8)}


def qc_label(maf: float, rsq: float) -> str:
    """File label of a filter from the digits after the decimal point."""
    return f"maf{str(maf)[2:]}rsq{str(rsq)[2:]}"


def qc_variants(info: DataFrame, maf: float, rsq: float) -> DataFrame:
    """Variants of enough frequency and quality, with their position columns."""
    return info.where((F.col("MAF") >= maf) & (F.col("RSQ") >= rsq)).withColumns(
        {
            "CHR": chromosome(F.col("SNP")),
            "BP": base_pair(F.col("SNP")),
            "RANGE": position_range(F.col("SNP")),
        }
    )


def target_variants(info: DataFrame, rsq: float = 0.3) -> DataFrame:
    return info.where(F.col("RSQ") > rsq)


def refine_quality(results: DataFrame, rsq: float = 0.8) -> DataFrame:
    return results.where(F.col("RSQ") > rsq)


def excluded_regions(spark) -> DataFrame:
    return spark.createDataFrame(EXCLUDED_REGIONS, REGIONS)


def _in_regions(variants: DataFrame, regions: DataFrame, how: str) -> DataFrame:
    """Range join as an equi-join on one-megabase bins plus a bound check."""
    bins = regions.select(
        F.col("CHR").alias("_chr"), F.col("START").alias("_start"), F.col("STOP").alias("_stop"),
        F.explode(F.sequence(F.floor(F.col("START") / BIN), F.floor(F.col("STOP") / BIN))).alias("_bin"),
    )
    condition = (
        (F.col("CHR") == F.col("_chr")) & (F.floor(F.col("BP") / BIN) == F.col("_bin"))
        & F.col("BP").between(F.col("_start"), F.col("_stop"))
    )
    return variants.join(bins, condition, how)


def exclude_regions(variants: DataFrame, regions: DataFrame) -> DataFrame:
    return _in_regions(variants, regions, "left_anti")


def keep_regions(variants: DataFrame, regions: DataFrame) -> DataFrame:
    return _in_regions(variants, regions, "left_semi")


def keep_positions(variants: DataFrame, listed: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Variants on a list; single-base ranges are the same as equal positions."""
    on = ["CHR", "BP"] if on is None else on
    return variants.join(listed.select(*on).distinct(), on, "left_semi")


def variant_counts(variants: DataFrame) -> DataFrame:
    return variants.groupBy("DATASET", "CHR").agg(F.count(F.lit(1)).alias("N_VARIANTS"))


def variant_blocks(variants: DataFrame, size: int = BLOCK_VARIANTS) -> DataFrame:
    """Block number of each variant: ``size`` consecutive variants per chromosome.

    Ordered inside one-megabase slices, so no chromosome sits on one task.
    """
    numbered = ordinal(
        variants, ["DATASET", "CHR"], ["BP"] + [c for c in ("A1", "A2", "SNP") if c in variants.columns],
        F.floor(F.col("BP") / BIN), "_n",
    )
    return numbered.withColumn("BLOCK", F.floor((F.col("_n") - 1) / F.lit(size)).cast("long")).drop("_n")


def hard_calls(geno: DataFrame) -> DataFrame:
    return geno.withColumn("GT", F.round("DOSAGE").cast("int"))


def impute_mean(geno: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Missing dosages become the mean of the variant's observed ones."""
    by = ["DATASET"] + VARIANT_KEY if by is None else by
    means = geno.groupBy(*by).agg(F.avg("DOSAGE").alias("_mean"))
    return geno.join(means, by).withColumn("DOSAGE", F.coalesce("DOSAGE", "_mean")).drop("_mean")


def variant_stats(geno: DataFrame, by: list[str]) -> DataFrame:
    """Genotype counts, allele frequency and missing rate per variant from GT."""
    gt = F.col("GT")
    counted = geno.groupBy(*by).agg(
        F.count_if(gt == 0).alias("N0"), F.count_if(gt == 1).alias("N1"), F.count_if(gt == 2).alias("N2"),
        F.count_if(gt.isNull()).alias("N_MISSING"), F.count(F.lit(1)).alias("N"),
    )
    called = F.col("N0") + F.col("N1") + F.col("N2")
    freq = (F.col("N1") + F.lit(2) * F.col("N2")) / (F.lit(2.0) * F.nullif(called, F.lit(0)))
    return counted.withColumns(
        {
            "ALT_FRQ": freq, "MAF": F.least(freq, F.lit(1.0) - freq),
            "MISSING_RATE": F.col("N_MISSING") / F.col("N"),
        }
    )


def merge_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two genotype sets; sites with more than two alleles overall drop out."""
    both = a.unionByName(b)
    alleles = both.select("CHR", "BP", F.explode(F.array("A1", "A2")).alias("ALLELE")).distinct()
    conflicting = alleles.groupBy("CHR", "BP").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2)
    return both.join(conflicting, ["CHR", "BP"], "left_anti")


def wide_to_long(wide: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Named dosage columns to (IID, VARIANT, DOSAGE); for the targeted tables."""
    ids = ids or [c for c in wide.columns if c in ("IID", "DOSE")]
    values = [c for c in wide.columns if c not in ids]
    return (
        wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
        .unpivot(ids, [F.col(f"`{c}`") for c in values], "VARIANT", "DOSAGE").drop("DOSE")
    )


def sample_index(samples: DataFrame) -> DataFrame:
    """Stable (DATASET, IID, SB, OFFSET): sample block and place within it."""
    ranked = global_rank(samples.select("DATASET", "IID").distinct(), ["DATASET"], ["IID"], "_n")
    place = F.col("_n") - F.lit(1)
    return ranked.select(
        "DATASET", "IID", F.floor(place / BLOCK_SAMPLES).cast("int").alias("SB"),
        (place % BLOCK_SAMPLES).cast("int").alias("OFFSET"),
    )


def to_array(geno: DataFrame, index: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per (variant, sample block) with the dosages of the block in order.

    A block holds at most ``BLOCK_SAMPLES`` samples, so rows stay bounded for
    cohorts of any size.
    """
    key = ["DATASET"] + VARIANT_KEY if key is None else key
    placed = geno.join(index, ["DATASET", "IID"])
    return dense_arrays(placed, [*key, "SB"], F.col("DOSAGE").cast("float"), "DOSAGE")


def dense_arrays(placed: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Arrays indexed by OFFSET; offsets without a row become NULL elements."""
    packed = placed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("OFFSET", value.alias("v")))).alias("_e")
    )

    def with_gap(entry: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get("_e", i - F.lit(1))["OFFSET"])
        blank = F.nullif(entry["v"], entry["v"])
        return F.concat(F.array_repeat(blank, entry["OFFSET"] - before - F.lit(1)), F.array(entry["v"]))

    return packed.select(*keys, F.flatten(F.transform("_e", with_gap)).alias(name))


def to_long(arrays: DataFrame, index: DataFrame, key: list[str] | None = None) -> DataFrame:
    key = ["DATASET"] + VARIANT_KEY if key is None else key
    spread = arrays.select(*key, "SB", F.posexplode("DOSAGE").alias("OFFSET", "_d"))
    return spread.join(index, ["DATASET", "SB", "OFFSET"]).select(
        *key, "IID", F.col("_d").cast("double").alias("DOSAGE")
    )


def in_all_parts(stacked: DataFrame, parts: int) -> DataFrame:
    """Rows of samples that are present in each of the parts that SOURCE numbers."""
    present = (
        stacked.select("DATASET", "IID", "SOURCE").distinct().groupBy("DATASET", "IID")
        .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == parts)
    )
    return stacked.join(present, ["DATASET", "IID"], "left_semi")


def common_samples(parts: list[DataFrame]) -> DataFrame:
    """Stack per-chromosome and score tables, keeping samples present in all.

    Long rows replace a chain of wide merges; ``SOURCE`` numbers the part.
    """
    tagged = [p.withColumn("SOURCE", F.lit(i)) for i, p in enumerate(parts)]
    return in_all_parts(reduce(DataFrame.unionByName, tagged), len(parts))


def long_to_wide(long: DataFrame, variants: list[str]) -> DataFrame:
    """Export form: one column per listed variant."""
    return long.groupBy("DATASET", "IID").pivot("POS", sorted(variants)).agg(F.max("DOSAGE"))


def by_position_first(lines: DataFrame, column: str = "value", sep: str = " ") -> DataFrame:
    """One line per position (the first field): the smallest whole line."""
    return (
        lines.groupBy(F.split_part(F.col(column), F.lit(sep), F.lit(1)).alias("POS"))
        .agg(F.min(column).alias(column))
    )
