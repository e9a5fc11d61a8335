"""Random-intercept scans and their marginal (GEE) counterpart.

For V = I + theta 11' per subject, A'V^-1 B needs only total cross-products
and, per number of visits, cross-products of subject sums.  Dosage is constant
within a subject, so both follow from one pass over (variant, subject) rows
with per-subject features; the variance search then runs on a few small
matrices per variant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscan.functions.columns import neglog10_p, two_sided_p
from cohortscan.functions.numeric import active_inverse, symmetric
from cohortscan.models.design import SET, join_genotypes, key_schema, prepare, result, triangle
from cohortscan.models.linear import NO_CONVERGE, NO_VARIANCE, STATUS_OK
from cohortscan.operators.bounded import attach_stats
from cohortscan.schemas import SCAN_KEY

LOG_THETA = np.concatenate([[-np.inf], np.linspace(np.log(1e-6), np.log(1e6), 49)])


def subject_features(table: DataFrame, covariates: list[str]) -> DataFrame:
    """Per subject: N_VISITS, sums u_a and cross-products c_a_b of all columns."""
    names = [*covariates, "Y"]
    return table.groupBy(*SET, "IID").agg(
        F.count(F.lit(1)).alias("N_VISITS"),
        *[F.sum(c).alias(f"u_{c}") for c in names],
        *[F.sum(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a, b in triangle(names)],
    )


class Terms:
    """Column expressions of subject sums and cross-products for one design."""

    def __init__(self, covariates: list[str], time: str | None):
        self.covariates, self.time = covariates, time
        self.order = covariates + ["Y"]
        self.fixed = ["1", "S", *covariates] + (["ST"] if time else [])
        self.names = self.fixed + ["Y"]
        self.tests = {"snp": 1} | ({"snp:time": len(self.fixed) - 1} if time else {})

    def _c(self, a: str, b: str) -> Column:
        if a == "1":
            return self._u(b)
        if b == "1":
            return self._u(a)
        if self.order.index(a) > self.order.index(b):
            a, b = b, a
        return F.col(f"c_{a}_{b}")

    def _u(self, a: str) -> Column:
        return F.col("N_VISITS").cast("double") if a == "1" else F.col(f"u_{a}")

    def _split(self, name: str) -> tuple[int, str]:
        """Power of the dosage and the within-subject part of a column."""
        return {"S": (1, "1"), "ST": (1, self.time)}.get(name, (0, name))

    def total(self, a: str, b: str) -> Column:
        (i, x), (j, y) = self._split(a), self._split(b)
        out = self._c(x, y)
        for _ in range(i + j):
            out = out * F.col("DOSAGE")
        return out

    def subject_sum(self, a: str) -> Column:
        i, x = self._split(a)
        return self._u(x) * F.col("DOSAGE") if i else self._u(x)


def binned_moments(geno: DataFrame, table: DataFrame, terms: Terms) -> DataFrame:
    """Per variant: one entry per number of visits with its packed matrices."""
    joined = join_genotypes(geno, subject_features(table, terms.covariates))
    pairs = triangle(terms.names)
    row = [
        F.col("N_VISITS").cast("double"), F.count(F.lit(1)).cast("double"),
        *[F.sum(terms.total(a, b)) for a, b in pairs],
        *[F.sum(terms.subject_sum(a) * terms.subject_sum(b)) for a, b in pairs],
    ]
    bins = joined.groupBy(*SCAN_KEY, "N_VISITS").agg(F.array(*row).alias("V"))
    n, g = F.get("V", F.lit(0)), F.get("V", F.lit(1))
    # A list has one entry per distinct number of visits.
    return bins.groupBy(*SCAN_KEY).agg(
        F.flatten(F.collect_list("V")).alias("BINS"),
        F.sum(n * g).cast("long").alias("N_OBS"), F.sum(g).cast("long").alias("N_GROUP"),
    )


class Moments:
    """Numeric form of a batch of binned moments, padded to the widest variant."""

    def __init__(self, bins: pd.Series, q: int):
        tri = q * (q + 1) // 2
        tables = [np.asarray(b).reshape(-1, 2 + 2 * tri) for b in bins]
        v, widest = len(tables), max(len(t) for t in tables)
        packed = np.zeros((v, widest, 2 + 2 * tri))
        packed[:, :, 0] = 1.0
        for i, t in enumerate(tables):
            packed[i, : len(t)] = t
        self.q, self.n, self.g = q, packed[:, :, 0], packed[:, :, 1]
        self.total = symmetric(packed[:, :, 2 : 2 + tri].sum(axis=1), q)
        self.sums = symmetric(packed[:, :, 2 + tri :].reshape(v * widest, tri), q).reshape(v, widest, q, q)
        self.count = (self.n * self.g).sum(axis=1)

    def weighted(self, c: np.ndarray) -> np.ndarray:
        """Total less sum over bins of c_n times the subject-sum products."""
        return self.total - np.einsum("vb,vbij->vij", c, self.sums)

    def fit(self, c: np.ndarray):
        """Generalised least squares for the given bin weights."""
        m = self.weighted(c)
        inverse, keep = active_inverse(m[:, :-1, :-1])
        beta = np.einsum("vij,vj->vi", inverse, m[:, :-1, -1])
        rss = m[:, -1, -1] - np.einsum("vi,vi->v", beta, m[:, :-1, -1])
        return m, inverse, keep, beta, np.maximum(rss, 1e-300)

    def reml(self, theta: np.ndarray) -> np.ndarray:
        """-2 log restricted likelihood, variance profiled out."""
        c = theta[:, None] / (1.0 + theta[:, None] * self.n)
        m, _, keep, _, rss = self.fit(c)
        p = keep.sum(axis=1)
        x = np.where(keep[:, :, None] & keep[:, None, :], m[:, :-1, :-1], 0.0)
        diagonal = np.arange(x.shape[1])
        x[:, diagonal, diagonal] = np.where(keep, x[:, diagonal, diagonal], 1.0)
        log_v = (self.g * np.log1p(theta[:, None] * self.n)).sum(axis=1)
        return (self.count - p) * np.log(rss / (self.count - p)) + log_v + np.linalg.slogdet(x)[1]

    def best_theta(self) -> tuple[np.ndarray, np.ndarray]:
        """Grid search then golden section on log theta; zero is a candidate.

        Also whether the optimum is bracketed: a ratio at the upper end of the
        grid is where the search stopped, not an estimate.
        """
        v = len(self.total)
        grid = np.array([self.reml(np.full(v, np.exp(t))) for t in LOG_THETA])
        at = np.clip(grid[1:].argmin(axis=0) + 1, 1, len(LOG_THETA) - 1)
        low = LOG_THETA[np.maximum(at - 1, 1)]
        high = LOG_THETA[np.minimum(at + 1, len(LOG_THETA) - 1)]
        ratio = (np.sqrt(5.0) - 1.0) / 2.0
        for _ in range(32):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            left = self.reml(np.exp(a)) < self.reml(np.exp(b))
            low, high = np.where(left, low, a), np.where(left, b, high)
        # The criterion is flat to rounding near its minimum; a parabola finds the vertex.
        centre, h = (low + high) / 2.0, 1e-4
        f0, up, down = (self.reml(np.exp(centre + d)) for d in (0.0, h, -h))
        bend = up - 2.0 * f0 + down
        shift = np.where(bend > 0, h * (down - up) / (2.0 * np.where(bend > 0, bend, 1.0)), 0.0)
        theta = np.exp(centre + np.clip(shift, -10.0 * h, 10.0 * h))
        return np.where(self.reml(theta) < grid[0], theta, 0.0), at < len(LOG_THETA) - 1


def _explode_terms(fits: DataFrame, model: dict[str, str], z: Column) -> DataFrame:
    ok = F.col("STATUS") == STATUS_OK
    named = fits.withColumns(
        {"STAT": F.when(ok, z), "NEGLOG10P": F.when(ok, neglog10_p(z)), "P": F.when(ok, two_sided_p(z)),
         "BETA": F.when(ok, F.col("BETA")), "SE": F.when(ok, F.col("SE"))}
    )
    out = None
    for term, name in model.items():
        part = result(named.where(F.col("TERM") == term), name)
        out = part if out is None else out.unionByName(part)
    return out


def _centred(table: DataFrame) -> DataFrame:
    return attach_stats(table, SET, _m=F.avg("Y")).withColumn("Y", F.col("Y") - F.col("_m")).drop("_m")


def mixed_scan(
    geno: DataFrame, rows: DataFrame, covariates: list[str], time: str | None = None,
    manifest: DataFrame | None = None, scale: bool = True,
) -> DataFrame:
    """REML random-intercept scan.

    Without ``time``: the dosage effect (lnmxi).  With it: dosage x time as
    lnmxs and the dosage effect of the same model as lnmxs_intcp.
    """
    name = "lnmxs" if time else "lnmxi"
    table = _centred(prepare(rows, covariates, ["Y"], manifest, name, scale))
    terms = Terms(covariates, time)
    moments = binned_moments(geno, table.withColumn("Y", F.col("Y").cast("double")), terms)
    q, tests = len(terms.names), terms.tests
    schema = key_schema(moments) + ", TERM string, BETA double, SE double, N_OBS long, N_GROUP long, STATUS string"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            m = Moments(batch["BINS"], q)
            theta, inside = m.best_theta()
            _, inverse, keep, beta, rss = m.fit(theta[:, None] / (1.0 + theta[:, None] * m.n))
            sigma = rss / (m.count - keep.sum(axis=1))
            for term, j in tests.items():
                out = batch[SCAN_KEY].copy()
                out["TERM"], out["BETA"] = term, beta[:, j]
                out["SE"] = np.sqrt(np.maximum(sigma * inverse[:, j, j], 0.0))
                out["N_OBS"], out["N_GROUP"] = batch["N_OBS"], batch["N_GROUP"]
                out["STATUS"] = np.where(keep[:, j], np.where(inside, STATUS_OK, NO_CONVERGE), NO_VARIANCE)
                yield out

    fits = moments.mapInPandas(solve, schema)
    models = {"snp": "lnmxs_intcp", "snp:time": "lnmxs"} if time else {"snp": "lnmxi"}
    return _explode_terms(fits, models, F.try_divide(F.col("BETA"), F.col("SE")))


def gee_scan(
    geno: DataFrame, rows: DataFrame, covariates: list[str], time: str = "YEARfDIAG",
    manifest: DataFrame | None = None, scale: bool = True,
) -> DataFrame:
    """Exchangeable-correlation GEE with robust errors; both dosage terms of every variant.

    The first pass gives the estimate and the moment correlation from binned
    sums.  The second adds up each subject's squared score along the two
    reported coefficients.
    """
    table = _centred(prepare(rows, covariates, ["Y"], manifest, "lnmxs", scale))
    terms = Terms(covariates, time)
    moments = binned_moments(geno, table, terms)
    q, tests = len(terms.names), terms.tests
    schema = key_schema(moments) + (
        ", ALPHA double, MOVED double, B array<double>, W array<array<double>>, OK array<boolean>, N_OBS long, N_GROUP long"
    )

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            m = Moments(batch["BINS"], q)
            alpha = np.zeros(len(batch))
            pairs = (m.g * m.n * (m.n - 1) / 2.0).sum(axis=1)
            moved = np.full(len(batch), np.inf)
            for _ in range(100):
                c = alpha[:, None] / (1.0 + (m.n - 1.0) * alpha[:, None])
                _, inverse, keep, beta, _ = m.fit(c)
                p = keep.sum(axis=1)
                g = np.concatenate([-beta, np.ones((len(beta), 1))], axis=1)
                squares = np.einsum("vi,vij,vj->v", g, m.total, g)
                sums = np.einsum("vi,vbij,vj->v", g, m.sums, g)
                phi = squares / (m.count - p)
                fresh = (sums - squares) / 2.0 / np.where(pairs > p, pairs - p, np.inf) / phi
                moved = np.abs(fresh - alpha)
                alpha = fresh
                if moved.max() < 1e-12:
                    break
            out = batch[SCAN_KEY].copy()
            out["ALPHA"], out["B"], out["MOVED"] = alpha, list(beta), moved
            out["W"] = [[row[j].tolist() for j in tests.values()] for row in inverse]
            out["OK"] = [[bool(row[j]) for j in tests.values()] for row in keep]
            out["N_OBS"], out["N_GROUP"] = batch["N_OBS"], batch["N_GROUP"]
            yield out

    from cohortscan.session import checkpointed

    state = checkpointed(moments.mapInPandas(estimate, schema))
    joined = join_genotypes(geno, subject_features(table, covariates)).join(
        state.select(*SCAN_KEY, "ALPHA", "B", "W"), SCAN_KEY
    )
    n = F.col("N_VISITS")
    c = F.col("ALPHA") / (F.lit(1.0) + (n - 1) * F.col("ALPHA"))
    fixed = terms.fixed
    b = [F.get("B", F.lit(i)) for i in range(len(fixed))]

    def residual_product(a: str) -> Column:
        """Sum over visits of column a times the residual."""
        return terms.total(a, "Y") - sum((terms.total(a, x) * b[i] for i, x in enumerate(fixed)), F.lit(0.0))

    residual_sum = terms.subject_sum("Y") - sum(
        (terms.subject_sum(x) * b[i] for i, x in enumerate(fixed)), F.lit(0.0)
    )
    scored = joined.withColumn("_r", residual_sum).withColumns(
        {f"_u{i}": residual_product(x) - c * terms.subject_sum(x) * F.col("_r") for i, x in enumerate(fixed)}
    )

    def along(k: int) -> Column:
        w = F.get("W", F.lit(k))
        return sum((F.get(w, F.lit(i)) * F.col(f"_u{i}") for i in range(len(fixed))), F.lit(0.0))

    meat = scored.groupBy(*SCAN_KEY).agg(
        *[F.sum(along(k) * along(k)).alias(f"_v{k}") for k in range(len(tests))]
    )
    both = meat.join(state, SCAN_KEY)
    rows_out = F.array(*[
        F.struct(
            F.lit(term).alias("TERM"), b[j].alias("BETA"), F.sqrt(f"_v{k}").alias("SE"),
            F.when(~F.get("OK", F.lit(k)), NO_VARIANCE).when(F.col("MOVED") < 1e-9, STATUS_OK)
            .otherwise(NO_CONVERGE).alias("STATUS"),
        )
        for k, (term, j) in enumerate(tests.items())
    ])
    fits = both.select(*SCAN_KEY, "N_OBS", "N_GROUP", F.inline(rows_out))
    models = {"snp": "lnmxs_intcp", "snp:time": "lnmxs"}
    return _explode_terms(fits, models, F.try_divide(F.col("BETA"), F.col("SE")))
