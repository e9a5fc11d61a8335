"""Random intercept and slope scan (first form of lnmxs).

With Z = [1, t] per subject and relative covariance D, the inverse of
I + Z D Z' needs only a 2x2 matrix per subject, so the restricted likelihood
at any D is a function of sums over subjects.  Each step evaluates a handful of
trial D for every variant in one sum over the subjects of a block; a quadratic
through them proposes the next ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.functions.columns import neglog10_p, two_sided_p
from cohortscan.functions.numeric import active_inverse
from cohortscan.models.arrays import Block, SubjectArrays, array_scan
from cohortscan.models.design import SET, prepare, result
from cohortscan.models.linear import NO_CONVERGE, NO_VARIANCE, STATUS_OK
from cohortscan.models.mixed import _centred
from cohortscan.operators.bounded import join_small
from cohortscan.operators.pheno import zscore
from cohortscan.session import checkpointed

MAX_ROUNDS = 25
# Starting points of the factor [[a, 0], [b, c]] of D.
START = np.array([[a, 0.0, c] for a in (0.3, 1.0, 3.0) for c in (0.1, 0.5, 2.0)])


def _trials(centre: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Centre, six axis points and three mixed points."""
    e = np.diag(h)
    axis = [centre + s * e[i] for i in range(3) for s in (1, -1)]
    mixed = [centre + e[i] + e[j] for i, j in ((0, 1), (0, 2), (1, 2))]
    return np.array([centre, *axis, *mixed])


def _propose(f: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton step of the quadratic through the trial values."""
    up, down = f[1:7:2], f[2:7:2]
    gradient = (up - down) / (2 * h)
    hessian = np.diag((up + down - 2 * f[0]) / h**2)
    for value, (i, j) in zip(f[7:], ((0, 1), (0, 2), (1, 2))):
        hessian[i, j] = hessian[j, i] = (value - up[i] - up[j] + f[0]) / (h[i] * h[j])
    curves, axes = np.linalg.eigh(hessian)
    curves = np.maximum(np.abs(curves), 1e-6 * max(np.abs(curves).max(), 1e-300))
    return -axes @ ((axes.T @ gradient) / curves)


class SlopeFit:
    """Restricted likelihood of y ~ 1 + s + covariates + s t + (1 + t | subject), profiled over D = L L'.

    A design column is a base column (one, covariate, response) times the
    dosage to a power; as the dosage is constant within a subject, sums over
    its visits are taken once for the base columns and scaled.
    """

    outputs = "BETA double, SE double, N_OBS long, N_GROUP long, VARIES boolean, DONE boolean"
    grid = None

    def __init__(self, covariates: list[str], time: str):
        self.columns = ["Y", *covariates]
        base = {c: i + 1 for i, c in enumerate(covariates)}
        self.time = base[time]
        y = len(covariates) + 1
        # (base column, power of the dosage); the tested column is the last fixed one.
        self.design = [(0, 0), (0, 1), *((i, 0) for i in range(1, y)), (self.time, 1), (y, 0)]

    def start(self, variants: int) -> dict:
        return {"trials": np.tile(START, (variants, 1, 1)), "h": np.full((variants, 3), np.nan), "best": np.zeros((variants, 3)),
                "fit": np.full(variants, np.nan), "beta": np.full(variants, np.nan), "se": np.full(variants, np.nan),
                "varies": np.ones(variants, bool), "done": np.zeros(variants, bool), "step": 0, "finished": False}

    def part(self, state: dict, block: Block) -> dict[str, np.ndarray]:
        at = np.flatnonzero(~state["done"])
        subjects, row = np.unique(block.place, return_inverse=True)
        base = np.column_stack([np.ones(len(row)), block.columns[:, 1:], block.columns[:, 0]])
        n, k, t = len(subjects), base.shape[1], base[:, self.time]

        def by_subject(x):
            return np.bincount(row, x, n)

        z0 = np.array([by_subject(c) for c in base.T])
        z1 = np.array([by_subject(c * t) for c in base.T])
        s = block.dosages[:, subjects]
        seen = ~np.isnan(s)
        s = np.where(seen, s, 0.0)
        out = {"n": (seen * z0[0]).sum(axis=1), "g": seen.sum(axis=1)} if state["step"] == 0 else {}
        s, seen, trials = s[at], seen[at], state["trials"][at]
        v, p = len(at), trials.shape[1]
        sums, logdet = np.empty((v, p, k, k, 3)), np.empty((v, p))
        cross = {(i, j): by_subject(base[:, i] * base[:, j]) for i in range(k) for j in range(i + 1)}
        for q in range(p):
            a, b, c = (trials[:, q, i, None] for i in range(3))
            d11, d12, d22 = a * a, a * b, b * b + c * c
            m11, m12 = 1 + d11 * z0[0] + d12 * z1[0], d11 * z1[0] + d12 * z1[self.time]
            m21, m22 = d12 * z0[0] + d22 * z1[0], 1 + d12 * z1[0] + d22 * z1[self.time]
            det = m11 * m22 - m12 * m21
            k11, k12, k22 = (m22 * d11 - m12 * d12) / det, (m22 * d12 - m12 * d22) / det, (m11 * d22 - m21 * d12) / det
            logdet[:, q] = (np.log(det) * seen).sum(axis=1)
            for (i, j), total in cross.items():
                rest = total - k11 * (z0[i] * z0[j]) - k12 * (z0[i] * z1[j] + z1[i] * z0[j]) - k22 * (z1[i] * z1[j])
                rest = rest * seen
                for power in range(3):
                    sums[:, q, i, j, power] = sums[:, q, j, i, power] = rest.sum(axis=1)
                    rest = rest * s
        return out | {"sums": sums, "logdet": logdet}

    def advance(self, state: dict, total: dict[str, np.ndarray]) -> dict:
        state = {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in state.items()}
        if state["step"] == 0:
            state |= {"n": np.round(total["n"]).astype(np.int64), "g": total["g"]}
        q = len(self.design)
        m = np.empty((*total["logdet"].shape, q, q))
        for i, (a, x) in enumerate(self.design):
            for j, (b, y) in enumerate(self.design):
                m[:, :, i, j] = total["sums"][:, :, a, b, x + y]
        at = np.flatnonzero(~state["done"])
        trials = np.empty((len(state["done"]), 10, 3))
        trials[:, : state["trials"].shape[1]] = state["trials"][:, :10]
        for place, i in enumerate(at):
            trials[i] = self._move(state, i, m[place], total["logdet"][place])
        state["trials"] = trials
        state["step"] += 1
        state["finished"] = bool(state["done"].all()) or state["step"] >= MAX_ROUNDS
        return state

    def _move(self, state: dict, i: int, m: np.ndarray, logdet: np.ndarray) -> np.ndarray:
        """The next trials of one variant, from the criterion at its present ones."""
        last, trials, n = len(self.design) - 2, state["trials"][i], int(state["n"][i])
        if n == 0:
            state["done"][i], state["varies"][i] = True, False
            return np.zeros((10, 3))
        inverse, keep = active_inverse(m[:, :-1, :-1])
        beta = np.einsum("vij,vj->vi", inverse, m[:, :-1, -1])
        rss = np.maximum(m[:, -1, -1] - np.einsum("vi,vi->v", beta, m[:, :-1, -1]), 1e-300)
        free = n - keep.sum(axis=1)
        x = np.where(keep[:, :, None] & keep[:, None, :], m[:, :-1, :-1], 0.0)
        diagonal = np.arange(last + 1)
        x[:, diagonal, diagonal] = np.where(keep, x[:, diagonal, diagonal], 1.0)
        f = free * np.log(rss / free) + logdet + np.linalg.slogdet(x)[1]
        best = int(np.argmin(f))
        if state["step"] == 0:  # starting grid
            h = 0.1 * np.maximum(np.abs(trials[best]), 0.2)
            state["h"][i], state["best"][i], state["fit"][i], state["varies"][i] = h, trials[best], f[best], keep[best, last]
            return _trials(trials[best], h)
        h, fit = state["h"][i].copy(), state["fit"][i]
        state["varies"][i] = keep[0, last]
        if f[best] > fit + 1e-9:  # the step overshot: go back, closer
            state["h"][i] = h / 4.0
            return _trials(state["best"][i], h / 4.0)
        if best != 0 and f[0] - f[best] > 1e-7:  # a side point is better than the centre
            step = np.clip(_propose(f, h), -1.0, 1.0) if f[0] <= fit + 1e-9 else trials[best] - trials[0]
        else:
            step = _propose(f, h)
        size = np.abs(step).max() / max(1.0, np.abs(trials[0]).max())
        flat = abs(fit - f[best]) < 1e-8 and f[0] - f[best] < 1e-8  # nothing left to gain
        if size < 1e-5 or flat:
            state["beta"][i] = beta[0, last]
            state["se"][i] = np.sqrt(max(rss[0] / free[0] * inverse[0, last, last], 0.0))
            state["done"][i] = True
            return trials
        limit = 0.5 * np.maximum(np.abs(trials[0]), 0.5)
        step = step * min(1.0, float((limit / np.maximum(np.abs(step), 1e-300)).min()))
        scale = np.maximum(np.abs(trials[0]), 0.2)
        fresh = scale * np.clip(np.abs(step).max() / scale, 1e-3, 0.05)
        state["h"][i], state["best"][i], state["fit"][i] = fresh, trials[best], f[best]
        return _trials(trials[0] + step, fresh)

    def output(self, state: dict) -> dict[str, np.ndarray]:
        return {"BETA": state["beta"], "SE": state["se"], "N_OBS": state["n"], "N_GROUP": state["g"],
                "VARIES": state["varies"], "DONE": state["done"]}


def random_slope_scan(
    geno: DataFrame | SubjectArrays, rows: DataFrame, covariates: list[str], time: str = "YEARfDIAG",
    manifest: DataFrame | None = None, raw_time: bool = True,
) -> DataFrame:
    """y ~ dosage + dosage:time + covariates + (1 + time | IID); the interaction term.

    The fit runs on standardised time, which changes nothing but the unit of
    the interaction; ``raw_time`` reports it per unit of ``time``.
    """
    plain = checkpointed(prepare(rows, covariates, ["Y"], manifest, "lnmxs", scale=False))
    spread = plain.groupBy(*SET).agg(F.stddev_samp(time).alias("_sd"))
    table = _centred(zscore(plain, covariates, SET).fillna(0.0, subset=covariates))
    fits = array_scan(geno, table, SlopeFit(covariates, time))
    if raw_time:
        fits = join_small(fits, spread, SET, "inner").withColumns(
            {"BETA": F.col("BETA") / F.col("_sd"), "SE": F.col("SE") / F.col("_sd")}
        )
    ok = F.col("VARIES") & F.col("DONE")
    z = F.try_divide(F.col("BETA"), F.col("SE"))
    return result(
        fits.withColumns(
            {"STAT": F.when(ok, z), "NEGLOG10P": F.when(ok, neglog10_p(z)), "P": F.when(ok, two_sided_p(z)),
             "TERM": F.lit("snp:time"), "BETA": F.when(ok, F.col("BETA")), "SE": F.when(ok, F.col("SE")),
             "STATUS": F.when(~F.col("VARIES"), NO_VARIANCE).when(ok, STATUS_OK).otherwise(NO_CONVERGE)}
        ),
        "lnmxs",
    )
