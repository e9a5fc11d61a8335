"""Post-analysis of pooled results: hits, cross-tabs, tiers, calibration."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscan.functions.columns import (
    CHI2_MEDIAN, base_pair, chi2_1_upper_quantile, chromosome, neglog10, neglog10_p, variant_label,
)
from cohortscan.operators.bounded import attach_stats, join_small
from cohortscan.operators.meta import TEST
from cohortscan.operators.ordered import exact_median, global_rank
from cohortscan.session import checkpointed

GENOME_WIDE_P = 5e-8
GENOME_WIDE_NEGLOG10P = 7.301
ALPHA_NEGLOG10P = -math.log10(0.05)


def hits(meta: DataFrame, p: float = GENOME_WIDE_P) -> DataFrame:
    return meta.where(F.col("NEGLOG10P") > F.lit(-math.log10(p)))


def hit_positions(metas: Iterable[DataFrame], p: float = GENOME_WIDE_P) -> DataFrame:
    """Distinct positions that are a hit in any of the tables."""
    lists = [hits(m, p).select("POS") for m in metas]
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out.distinct()


def variant_list(*lists: DataFrame) -> DataFrame:
    """Union of position lists, one row per position."""
    out = lists[0].select("POS")
    for other in lists[1:]:
        out = out.unionByName(other.select("POS"))
    return out.distinct()


def lookup(results: DataFrame, positions: DataFrame) -> DataFrame:
    """Every result row at the listed positions, matched exactly."""
    return results.join(positions.select("POS").distinct(), "POS", "left_semi")


def forest_rows(results: DataFrame, pos: str) -> DataFrame:
    return results.where(F.col("POS") == pos)


def top_hits(results: DataFrame, k: int) -> DataFrame:
    return results.orderBy(F.col("NEGLOG10P").desc(), "POS").limit(k)


def test_name() -> Column:
    return F.concat_ws("_", "OUTCOME", "MODEL")


def without_tests(meta: DataFrame, *fragments: str) -> DataFrame:
    """Leave out tests whose name holds one of the fragments (before any pivot)."""
    name = test_name()
    for fragment in fragments:
        meta = meta.where(~F.contains(name, F.lit(fragment)))
    return meta


def crosstab(meta: DataFrame, tests: list[str] | None = None) -> DataFrame:
    """POS x OUTCOME_MODEL table of -log10 P, columns in alphabetic order.

    One aggregate replaces a chain of full joins.  Columns are a stated list
    of tests; without one the table stays long (POS, TEST, NEGLOG10P), which
    holds any number of tests.
    """
    long = meta.select("POS", test_name().alias("TEST"), "NEGLOG10P")
    if tests is None:
        return long.groupBy("POS", "TEST").agg(F.max("NEGLOG10P").alias("NEGLOG10P"))
    return long.groupBy("POS").pivot("TEST", sorted(tests)).agg(F.max("NEGLOG10P"))


def test_counts(meta_long: DataFrame) -> DataFrame:
    """Add N_TESTS per variant and N_VARIANTS per test from non-null cells."""
    meta_long = checkpointed(meta_long)  # read three times below
    per_variant = meta_long.groupBy("POS").agg(
        F.count("NEGLOG10P").alias("N_TESTS")
    )
    counted = meta_long.join(per_variant, "POS")
    return attach_stats(counted, TEST, N_VARIANTS=F.count("NEGLOG10P"))


def tiers(meta_long: DataFrame) -> DataFrame:
    """Multiplicity tier 0-5 per (POS, test) cell.

    One point each for: a result, P < 0.05, and Bonferroni over tests of the
    variant, variants of the test, and both.
    """
    x = F.col("NEGLOG10P")

    def beats(*counts: str) -> Column:
        bar = F.lit(ALPHA_NEGLOG10P)
        for c in counts:
            bar = bar + F.log10(F.col(c).cast("double"))
        return (x > bar).cast("int")

    tier = (
        x.isNotNull().cast("int") + beats() + beats("N_TESTS") + beats("N_VARIANTS")
        + beats("N_TESTS", "N_VARIANTS")
    )
    return test_counts(meta_long).where(F.col("N_TESTS") > 0).withColumn(
        "TIER", F.coalesce(tier, F.lit(0))
    )


def fixed_tiers(meta_long: DataFrame, n_tests: int = 40, n_variants: int = 92) -> DataFrame:
    """Tiers 1-5 from cuts that do not depend on the table."""
    cuts = [0.05, 0.05 / n_tests, 0.05 / n_variants, 0.05 / n_variants / n_tests]
    x = F.col("NEGLOG10P")
    bars = [-math.log10(c) for c in cuts]
    tier = (
        F.when(x <= bars[0], 1).when(x <= bars[1], 2).when(x <= bars[2], 3)
        .when(x <= bars[3], 4).when(x > bars[3], 5)
    )
    return meta_long.withColumn("TIER", tier)


def row_hits(meta_long: DataFrame, bar: float = GENOME_WIDE_NEGLOG10P) -> DataFrame:
    """Variants with at least one cell above the bar, with the number of such cells."""
    return (
        meta_long.groupBy("POS")
        .agg(F.count_if(F.col("NEGLOG10P") > bar).alias("N_HITS"))
        .where(F.col("N_HITS") > 0)
    )


def annotate(table: DataFrame, rsids: DataFrame, how: str = "inner") -> DataFrame:
    """Join names on POS (both sides may be large: the planner picks the join)."""
    return table.join(rsids, "POS", how)


def predictors_with_results(info: DataFrame, table: DataFrame) -> DataFrame:
    """All listed predictors and all tested positions, matched where possible."""
    return info.join(table, "POS", "full")


def label_rows(table: DataFrame, gene: str = "NEAR_GENE", gap: str = "") -> DataFrame:
    return table.withColumn("LABEL", variant_label(F.col("POS"), F.col("ID"), F.col(gene), gap))


def genomic_order(table: DataFrame) -> DataFrame:
    return table.orderBy(chromosome(F.col("POS")), base_pair(F.col("POS")), "POS")


def byte_order(table: DataFrame) -> DataFrame:
    """Binary order of the position text, as the exported text tables use."""
    return table.orderBy("POS")


def above(table: DataFrame, column: str, bar: float) -> DataFrame:
    """Rows of an annotated table whose named number exceeds a bar; NULL does not."""
    return table.where(F.col(column).try_cast("double") > bar)


def split_scores(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variant rows (``CHR:BP``) and score rows of one result table."""
    is_variant = F.col("POS").rlike("^[0-9]+:")
    return table.where(is_variant), table.where(~is_variant)


def append_scores(variants: DataFrame, scores: DataFrame) -> DataFrame:
    return variants.unionByName(scores, allowMissingColumns=True)


def lambda_gc(meta: DataFrame, by: list[str] | None = None, p: str = "P") -> DataFrame:
    """Genomic inflation: quantile of the exact median P over that of one half."""
    by = TEST if by is None else by
    return exact_median(meta, by, F.col(p)).select(
        *by, F.col("N").alias("N_VARIANTS"), F.col("MEDIAN").alias("MEDIAN_P"),
        (chi2_1_upper_quantile(F.col("MEDIAN")) / F.lit(CHI2_MEDIAN)).alias("LAMBDA"),
    )


def qq_points(meta: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Observed against expected -log10 P per result set."""
    by = TEST if by is None else by
    base = meta.where(F.col("NEGLOG10P").isNotNull()).withColumn("_order", -F.col("NEGLOG10P"))
    ranked = global_rank(base.select(*by, "POS", "NEGLOG10P", "_order"), by, ["_order", "POS"], "RANK")
    counts = ranked.groupBy(*by).agg(F.max("RANK").alias("N"))
    return join_small(ranked, counts, by, "inner").select(
        *by, "POS", "RANK", F.col("NEGLOG10P").alias("OBSERVED"),
        (-F.log10(F.col("RANK") / (F.col("N") + F.lit(1.0)))).alias("EXPECTED"),
    )


def manhattan_points(
    meta: DataFrame, by: list[str] | None = None, max_lambda: float | None = 1.1
) -> DataFrame:
    """-log10 P at cumulative genome coordinates, for well calibrated sets only."""
    by = TEST if by is None else by
    meta = checkpointed(meta)  # read for the lengths, the points and the calibration
    if max_lambda is not None:
        calm = lambda_gc(meta, by).where(F.col("LAMBDA") < max_lambda).select(*by)
        meta = join_small(meta, calm, by, "left_semi")
    placed = meta.withColumns({"CHR": chromosome(F.col("POS")), "BP": base_pair(F.col("POS"))})
    lengths = placed.groupBy("CHR").agg(F.max("BP").alias("LEN"))
    # One row per chromosome, so the single-task window is bounded.
    earlier = Window.orderBy("CHR").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select("CHR", F.coalesce(F.sum("LEN").over(earlier), F.lit(0)).alias("OFFSET"))
    return join_small(placed, offsets, ["CHR"], "inner").select(
        *by, "POS", "CHR", "BP", (F.col("BP") + F.col("OFFSET")).alias("GENOME_X"), "NEGLOG10P"
    )


def plot_bound(meta: DataFrame, by: list[str] | None = None, least: float = 10.0) -> DataFrame:
    """Upper axis limit and number of points per result set."""
    by = TEST if by is None else by
    return meta.groupBy(*by).agg(
        F.greatest(F.max("NEGLOG10P"), F.lit(least)).alias("Y_MAX"),
        F.count(F.lit(1)).alias("N_POINTS"),
    )


def with_neglog10p(table: DataFrame, p: str = "P") -> DataFrame:
    """-log10 P of tables that only carry P.

    A P that was stored as 0 follows from Effect and StdErr where both are
    there, so that the result stays finite.
    """
    stored = neglog10(F.col(p))
    if {"Effect", "StdErr"} <= set(table.columns):
        z = F.try_divide(F.col("Effect"), F.col("StdErr"))
        stored = F.when((F.col(p) == 0) & z.isNotNull(), neglog10_p(z)).otherwise(stored)
    return table.withColumn("NEGLOG10P", stored)
