"""Logistic scan at baseline (model lgsbl)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.functions.columns import neglog10_p, two_sided_p
from cohortscan.functions.numeric import active_inverse
from cohortscan.models.arrays import Block, SubjectArrays, array_scan, weighted_sums
from cohortscan.models.design import prepare, result
from cohortscan.models.linear import NO_CONVERGE, NO_VARIANCE, STATUS_OK

MAX_STEPS = 25
TOLERANCE = 1e-8


class LogisticFit:
    """Newton steps of all variants together; a variant that has settled is left out of further steps."""

    outputs = "B double, SE double, N_OBS long, N_EVENT long, VARIES boolean, DONE boolean"
    grid = None

    def __init__(self, covariates: list[str]):
        self.columns = ["Y", *covariates]

    def start(self, variants: int) -> dict:
        return {"beta": np.zeros((variants, len(self.columns) + 1)), "dev": np.full(variants, np.nan), "se": np.full(variants, np.nan),
                "varies": np.ones(variants, bool), "done": np.zeros(variants, bool), "step": 0, "finished": False}

    def part(self, state: dict, block: Block) -> dict[str, np.ndarray]:
        at = np.flatnonzero(~state["done"])
        s, seen = block.of_rows()
        y = block.columns[:, 0]
        x = np.column_stack([np.ones(len(y)), block.columns[:, 1:]])
        q = x.shape[1]
        beta, s1, seen1 = state["beta"][at], s[at], seen[at]
        eta = beta[:, :q] @ x.T + beta[:, q:] * s1
        mu = 1.0 / (1.0 + np.exp(-eta))
        w, r = mu * (1.0 - mu) * seen1, (y - mu) * seen1
        soft = np.maximum(eta, 0.0) + np.log1p(np.exp(-np.abs(eta)))
        products = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        out = {"h": weighted_sums(w, s1, x, products), "g": np.column_stack([r @ x, (r * s1).sum(axis=1)]),
               "dev": 2.0 * ((soft - y * eta) * seen1).sum(axis=1)}
        if state["step"] == 0:
            out |= {"n": seen.sum(axis=1), "e": (seen * y).sum(axis=1)}
        return out

    def advance(self, state: dict, total: dict[str, np.ndarray]) -> dict:
        at = np.flatnonzero(~state["done"])
        state = {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in state.items()}
        if state["step"] == 0:
            state |= {"n": total["n"], "e": np.round(total["e"]).astype(np.int64)}
        # The dosage comes before the covariates, so it is they that drop out as aliased.
        q = total["g"].shape[1] - 1
        order = [0, q, *range(1, q)]
        inverse, keep = active_inverse(total["h"][:, order][:, :, order])
        state["beta"][np.ix_(at, order)] += np.einsum("vij,vj->vi", inverse, total["g"][:, order])
        state["se"][at], state["varies"][at] = np.sqrt(np.maximum(inverse[:, 1, 1], 0.0)), keep[:, 1]
        new = total["dev"]
        with np.errstate(invalid="ignore"):
            state["done"][at] = np.abs(new - state["dev"][at]) / (np.abs(new) + 0.1) < TOLERANCE
        state["dev"][at] = new
        state["step"] += 1
        state["finished"] = bool(state["done"].all()) or state["step"] >= MAX_STEPS
        return state

    def output(self, state: dict) -> dict[str, np.ndarray]:
        return {"B": state["beta"][:, -1], "SE": state["se"], "N_OBS": state["n"], "N_EVENT": state["e"],
                "VARIES": state["varies"], "DONE": state["done"]}


def logistic_scan(
    geno: DataFrame | SubjectArrays, rows: DataFrame, covariates: list[str], manifest: DataFrame | None = None,
    scale: bool = True,
) -> DataFrame:
    """Case (Y = 2) against control (Y = 1) ~ dosage + covariates, by maximum likelihood."""
    coded = rows.where(F.col("Y") > 0)
    table = prepare(coded, covariates, ["Y"], manifest, "lgsbl", scale)
    table = table.withColumn("Y", (F.col("Y") == 2).cast("double"))
    fits = array_scan(geno, table, LogisticFit(covariates))
    # Events and non-events are both needed; all-or-nothing outcomes run off to infinity.
    ok = F.col("VARIES") & F.col("DONE")
    z = F.col("B") / F.nullif(F.col("SE"), F.lit(0.0))
    return result(
        fits.withColumns(
            {"BETA": F.when(ok, F.col("B")), "STAT": F.when(ok, z), "NEGLOG10P": F.when(ok, neglog10_p(z)),
             "P": F.when(ok, two_sided_p(z)), "TERM": F.lit("snp"), "N_GROUP": F.col("N_OBS"),
             "STATUS": F.when(~F.col("VARIES"), NO_VARIANCE).when(ok, STATUS_OK).otherwise(NO_CONVERGE),
             "SE": F.when(ok, F.col("SE"))}
        ),
        "lgsbl",
    )
