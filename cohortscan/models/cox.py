"""Cox proportional hazards scan over counting-process intervals (model coxhm)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.functions.columns import neglog10_p, two_sided_p
from cohortscan.functions.numeric import active_inverse
from cohortscan.models.arrays import Block, SubjectArrays, array_scan, weighted_sums
from cohortscan.models.design import prepare, result
from cohortscan.models.linear import NO_CONVERGE, NO_VARIANCE, STATUS_OK

MAX_STEPS = 30
TOLERANCE = 1e-9


class RiskSets:
    """Sums over the rows at risk at each event time of a set, and over the rows with an event there."""

    def __init__(self, start: np.ndarray, stop: np.ndarray, event: np.ndarray, times: np.ndarray):
        self.event, self.times = event, times
        grid = np.arange(1, len(times) + 1)
        self.low, self.high = (np.searchsorted(times, t, "right") for t in (start, stop))
        self.by_low, self.by_high = np.argsort(self.low, kind="stable"), np.argsort(self.high, kind="stable")
        self.from_low = np.searchsorted(self.low[self.by_low], grid)
        self.from_high = np.searchsorted(self.high[self.by_high], grid)
        dead = np.flatnonzero(event)
        self.deaths = dead[np.argsort(self.high[dead], kind="stable")]
        at = self.high[self.deaths]
        self.first, self.last = np.searchsorted(at, grid), np.searchsorted(at, grid, "right")

    def at_risk(self, x: np.ndarray) -> np.ndarray:
        """Rows enter the suffix sums at their stop and leave them at their start."""
        def suffix(order, start):
            total = np.concatenate([np.cumsum(x[:, order[::-1]], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)
            return total[:, start]

        return suffix(self.by_high, self.from_high) - suffix(self.by_low, self.from_low)

    def with_event(self, x: np.ndarray) -> np.ndarray:
        """Sums at each time; few rows have an event, and most times of a block have one or none."""
        out = np.zeros((len(x), len(self.times)))
        own = x[:, self.deaths]
        for k in range(int((self.last - self.first).max(initial=0))):
            has = np.flatnonzero(self.last - self.first > k)
            out[:, has] += own[:, self.first[has] + k]
        return out

    def over_risk(self, at_times: np.ndarray) -> np.ndarray:
        """For each row the sum of ``at_times`` over the event times at which it is at risk."""
        total = np.concatenate([np.zeros((len(at_times), 1)), np.cumsum(at_times, axis=1)], axis=1)
        return total[:, self.high] - total[:, self.low]


class CoxFit:
    """Efron partial likelihood; the dosage is the first coefficient.

    A step has two sums.  The first is taken at the event times: at risk and
    with an event there, of the risk and of risk times covariates.  From its
    total follow likelihood, score, and one weight for each row, its hazard;
    the second sum is the weighted matrix of products over rows.  No array
    over times holds more than one covariate index.
    """

    outputs = "B double, SE double, N_OBS long, N_EVENT long, N_GROUP long, VARIES boolean, DONE boolean"
    grid = ("TSTOP", "EVENT")

    def __init__(self, covariates: list[str]):
        self.columns = ["TSTART", "TSTOP", "EVENT", *covariates]

    def start(self, variants: int) -> dict:
        p = len(self.columns) - 2
        return {"beta": np.zeros((variants, p)), "last": np.zeros((variants, p)), "ll": np.full(variants, np.nan),
                "se": np.full(variants, np.nan), "varies": np.zeros(variants, bool), "done": np.zeros(variants, bool),
                "step": 0, "finished": False, "weights": None}

    def part(self, state: dict, block: Block) -> dict[str, np.ndarray]:
        at = np.flatnonzero(~state["done"])
        s, seen = block.of_rows()
        start, stop, event = block.columns[:, 0], block.columns[:, 1], block.columns[:, 2] == 1
        x = block.columns[:, 3:]
        sets = RiskSets(start, stop, event, block.grid)
        counts = {}
        if state["step"] == 0 and state["weights"] is None:
            counts = {"n": seen.sum(axis=1), "e": (seen & event).sum(axis=1),
                      "g": (~np.isnan(block.dosages[:, np.unique(block.place)])).sum(axis=1)}
        s, seen, beta = s[at], seen[at], state["beta"][at]
        lp = beta[:, :1] * s + beta[:, 1:] @ x.T
        r = np.exp(lp) * seen
        if state["weights"] is not None:
            up, tied = state["weights"]
            w = sets.over_risk(up)
            dead = np.flatnonzero(event)
            w[:, dead] -= tied[:, sets.high[dead] - 1]
            products = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
            return {"h": weighted_sums(r * w, s, x, products)}
        dead = seen & event
        columns = [s, *(np.broadcast_to(c, s.shape) for c in x.T)]
        return counts | {
            "deaths": sets.with_event(dead.astype(float)), "risk": sets.at_risk(r), "tied": sets.with_event(r * event),
            "risk1": np.stack([sets.at_risk(r * c) for c in columns], axis=2),
            "tied1": np.stack([sets.with_event(r * event * c) for c in columns], axis=2),
            "ll": (lp * dead).sum(axis=1), "score": np.stack([(c * dead).sum(axis=1) for c in columns], axis=1),
        }

    def advance(self, state: dict, total: dict[str, np.ndarray]) -> dict:
        state = {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in state.items()}
        return self._at_times(state, total) if state["weights"] is None else self._newton(state, total["h"])

    def _at_times(self, state: dict, t: dict[str, np.ndarray]) -> dict:
        if state["step"] == 0:
            state |= {"n": t["n"], "e": t["e"], "g": t["g"]}
        deaths, values = t["deaths"], t["ll"].copy()
        up, tied, *second = (np.zeros_like(deaths) for _ in range(5))
        with np.errstate(invalid="ignore", divide="ignore"):
            # Deaths tied at a time share its risk set less a growing part of themselves.
            for k in range(int(deaths.max(initial=0))):
                live = deaths > k
                share = np.where(live, k / np.where(live, deaths, 1.0), 0.0)
                s0 = np.where(live, t["risk"] - share * t["tied"], 1.0)
                one = live / s0
                up, tied = up + one, tied + share * one
                for i in range(3):
                    second[i] = second[i] + share**i * one / s0
                values -= np.where(live, np.log(s0), 0.0).sum(axis=1)
            r1, t1 = t["risk1"], t["tied1"]
            score = t["score"] - np.einsum("vj,vja->va", up, r1) + np.einsum("vj,vja->va", tied, t1)
            mixed = np.einsum("vja,vjb->vab", second[1][:, :, None] * r1, t1)
            squares = np.einsum("vja,vjb->vab", second[0][:, :, None] * r1, r1) - mixed - mixed.transpose(0, 2, 1)
            squares += np.einsum("vja,vjb->vab", second[2][:, :, None] * t1, t1)
        if not deaths.shape[1]:
            return state | {"finished": True}
        return state | {"weights": (up, tied), "values": values, "score": score, "squares": squares}

    def _newton(self, state: dict, h: np.ndarray) -> dict:
        at = np.flatnonzero(~state["done"])
        p = h.shape[1]
        order = [p - 1, *range(p - 1)]
        information = h[:, order][:, :, order] - state["squares"]
        inverse, keep = active_inverse(information, 1e-9)
        values, beta, last, ll = state["values"], state["beta"], state["last"], state["ll"]
        state["se"][at], state["varies"][at] = np.sqrt(np.maximum(inverse[:, 0, 0], 0.0)), keep[:, 0]
        old = ll[at]
        with np.errstate(invalid="ignore", divide="ignore"):
            worse = np.isfinite(old) & (values < old - 1e-9 * np.abs(old))
            settled = ~worse & ((values == 0) | (np.isfinite(old) & (np.abs(1.0 - old / values) < TOLERANCE)))
        ahead = beta[at] + np.einsum("vij,vj->vi", inverse, state["score"])
        halved = (beta[at] + last[at]) / 2.0
        last[at] = np.where(worse[:, None], last[at], beta[at])
        beta[at] = np.where(worse[:, None], halved, ahead)
        ll[at] = np.where(worse, old, values)
        state["done"][at] = settled
        state["step"] += 1
        state["finished"] = bool(state["done"].all()) or state["step"] >= MAX_STEPS
        return state | {"weights": None, "values": None, "score": None, "squares": None}

    def output(self, state: dict) -> dict[str, np.ndarray]:
        return {"B": state["last"][:, 0], "SE": state["se"], "N_OBS": state["n"], "N_EVENT": state["e"], "N_GROUP": state["g"],
                "VARIES": state["varies"], "DONE": state["done"]}


def cox_scan(
    geno: DataFrame | SubjectArrays, rows: DataFrame, covariates: list[str], manifest: DataFrame | None = None,
    scale: bool = True,
) -> DataFrame:
    """Surv(TSTART, TSTOP, EVENT) ~ dosage + covariates with Efron ties.

    A risk-set sum at an event time is a suffix sum over the rows in order of
    their ends: rows enter at their stop and are taken out at their start, so
    no interval join is needed.  Counts are over all intervals, including
    those that end before any event.
    """
    table = prepare(rows, covariates, ["TSTART", "TSTOP", "EVENT"], manifest, "coxhm", scale)
    fits = array_scan(geno, table, CoxFit(covariates))
    ok = F.col("VARIES") & F.col("DONE")
    z = F.col("B") / F.nullif(F.col("SE"), F.lit(0.0))
    return result(
        fits.withColumns(
            {"BETA": F.when(ok, F.col("B")), "STAT": F.when(ok, z), "NEGLOG10P": F.when(ok, neglog10_p(z)),
             "P": F.when(ok, two_sided_p(z)), "TERM": F.lit("snp"),
             "STATUS": F.when(~F.col("VARIES"), NO_VARIANCE).when(ok, STATUS_OK).otherwise(NO_CONVERGE),
             "SE": F.when(ok, F.col("SE"))}
        ),
        "coxhm",
    )
