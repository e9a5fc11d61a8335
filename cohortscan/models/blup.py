"""Per-subject random-slope predictions from within-subject data."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscan.functions.numeric import active_inverse, symmetric
from cohortscan.models.design import SET, key_schema, triangle
from cohortscan.operators.bounded import join_small
from cohortscan.operators.contrast import demean
from cohortscan.operators.pheno import complete_cases
from cohortscan.session import checkpointed

GRID, ROUNDS, POLISH = 17, 7, 1e-4


def slope_blup(
    rows: DataFrame, time: str = "YEARfDIAG", others: list[str] | None = None
) -> DataFrame:
    """(DATASET, OUTCOME, IID, SLOPE): y' ~ others' - 1 + (time' - 1 | IID) by REML.

    The slope variance ratio is found on a grid that narrows every round; a
    round is one aggregation over (subject, candidate) rows, so no cohort is
    gathered anywhere.
    """
    others = others or []
    names = [*others, "Y"]
    columns = {c: F.col(c).cast("double") for c in [time, *names]}
    kept = complete_cases(rows, [time, *names]).select(*SET, "IID", *[c.alias(n) for n, c in columns.items()])
    inner = demean(kept, SET + ["IID"], [time, *names])
    subject = checkpointed(inner.groupBy(*SET, "IID").agg(
        (F.count(F.lit(1)) - 1).alias("n"), F.sum(F.col(time) * F.col(time)).alias("tt"),
        *[F.sum(F.col(time) * F.col(c)).alias(f"t_{c}") for c in names],
        *[F.sum(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a, b in triangle(names)],
    ))
    p = len(others)
    theta = F.col("THETA")
    shrink = theta / (F.lit(1.0) + theta * F.col("tt"))

    def product(a: str, b: str) -> Column:
        return F.sum(F.col(f"c_{a}_{b}") - shrink * F.col(f"t_{a}") * F.col(f"t_{b}"))

    def evaluate(candidates: DataFrame) -> DataFrame:
        """Restricted likelihood and coefficients at each candidate ratio."""
        sums = join_small(subject, candidates.groupBy(*SET).agg(F.collect_list("THETA").alias("_all")), SET, "inner")
        sums = sums.withColumn("THETA", F.explode("_all")).groupBy(*SET, "THETA").agg(
            F.array(*[product(a, b) for a, b in triangle(names)]).alias("M"),
            F.sum(F.log1p(theta * F.col("tt"))).alias("LOGV"), F.sum("n").alias("N"),
        )
        schema = key_schema(sums, SET) + ", THETA double, CRITERION double, B array<double>"

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if batch.empty:
                    continue
                full = symmetric(np.stack(batch["M"].to_numpy()), p + 1)
                n, logdet, free = batch["N"].to_numpy(float), np.zeros(len(batch)), np.zeros(len(batch))
                beta, rss = np.zeros((len(batch), p)), full[:, p, p]
                if p:
                    inverse, keep = active_inverse(full[:, :p, :p])
                    beta = np.einsum("vij,vj->vi", inverse, full[:, :p, p])
                    rss = rss - np.einsum("vi,vi->v", beta, full[:, :p, p])
                    free = keep.sum(axis=1)
                    x = np.where(keep[:, :, None] & keep[:, None, :], full[:, :p, :p], 0.0)
                    x[:, range(p), range(p)] = np.where(keep, x[:, range(p), range(p)], 1.0)
                    logdet = np.linalg.slogdet(x)[1]
                out = batch[SET + ["THETA"]].copy()
                out["CRITERION"] = (n - free) * np.log(np.maximum(rss, 1e-300) / (n - free)) + batch["LOGV"] + logdet
                out["B"] = list(beta)
                yield out

        return sums.mapInPandas(solve, schema)

    low, high = math.log(1e-6), math.log(1e6)
    sets = subject.select(*SET).distinct()
    steps = F.sequence(F.lit(0), F.lit(GRID - 1))
    log_points = F.transform(steps, lambda i: F.col("LOW") + (F.col("HIGH") - F.col("LOW")) * i / F.lit(GRID - 1.0))
    bounds = sets.select(*SET, F.lit(low).alias("LOW"), F.lit(high).alias("HIGH"))
    best = None
    spacing = (high - low) / (GRID - 1.0)
    for turn in range(ROUNDS):
        points = bounds.select(*SET, F.explode(F.transform(log_points, F.exp)).alias("THETA"))
        if turn == 0:
            points = points.unionByName(sets.select(*SET, F.lit(0.0).alias("THETA")))
        found = evaluate(points).groupBy(*SET).agg(F.min(F.struct("CRITERION", "THETA", "B")).alias("w"))
        if best is not None:
            found = found.unionByName(best).groupBy(*SET).agg(F.min("w").alias("w"))
        best = checkpointed(found)
        width = 1.5 * spacing
        spacing = 2.0 * width / (GRID - 1.0)
        centre = F.when(F.col("w.THETA") > 0, F.log("w.THETA")).otherwise(F.lit(low))
        bounds = best.select(*SET, (centre - width).alias("LOW"), (centre + width).alias("HIGH"))
    # The criterion is flat to rounding near its minimum; a parabola finds the vertex.
    ratio = F.col("w.THETA")
    near = best.select(*SET, F.explode(F.array(*[ratio * math.exp(k * POLISH) for k in (-1, 0, 1)])).alias("THETA"))
    side = evaluate(near).groupBy(*SET).agg(F.array_sort(F.collect_list(F.struct("THETA", "CRITERION"))).alias("c"))
    f = [F.get("c", F.lit(i))["CRITERION"] for i in range(3)]
    bend = f[0] - 2 * f[1] + f[2]
    move = F.greatest(F.lit(-0.01), F.least(F.lit(0.01), F.lit(POLISH) * (f[0] - f[2]) / (2 * bend)))
    middle = F.get("c", F.lit(1))["THETA"]
    final = side.select(*SET, F.when((middle > 0) & (bend > 0), middle * F.exp(move)).otherwise(F.get("c", F.lit(0))["THETA"]).alias("THETA"))
    fitted = checkpointed(evaluate(checkpointed(final)).select(*SET, "THETA", "B"))
    residual = F.col("t_Y")
    for i, c in enumerate(others):
        residual = residual - F.col(f"t_{c}") * F.get("B", F.lit(i))
    return join_small(subject, fitted, SET, "inner").select(*SET, "IID", (shrink * residual).alias("SLOPE"))
