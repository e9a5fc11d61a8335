"""Small vectorised numeric helpers used inside Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LN10 = math.log(10.0)


def symmetric(packed: np.ndarray, p: int) -> np.ndarray:
    """(V, p(p+1)/2) packed upper triangles to (V, p, p) matrices."""
    out = np.zeros((len(packed), p, p))
    rows, cols = np.triu_indices(p)
    out[:, rows, cols] = packed
    out[:, cols, rows] = packed
    return out


def active_inverse(matrices: np.ndarray, eps: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Inverses over the columns that carry information, with that column mask.

    A column that is zero or a combination of earlier ones gets zero rows, as
    a regression that drops aliased terms would.  The pivot test is a running
    sweep relative to the column's own size.
    """
    v, p, _ = matrices.shape
    scale = np.sqrt(np.maximum(np.einsum("vii->vi", matrices), 0.0))
    safe = np.where(scale > 0, scale, 1.0)
    work = matrices / (safe[:, :, None] * safe[:, None, :])
    left = work.copy()
    keep = np.zeros((v, p), dtype=bool)
    for j in range(p):
        pivot = left[:, j, j]
        good = (pivot > eps) & (scale[:, j] > 0)
        keep[:, j] = good
        column = np.where(good[:, None], left[:, :, j], 0.0)
        left = left - column[:, :, None] * column[:, None, :] / np.where(good, pivot, 1.0)[:, None, None]
    both = keep[:, :, None] & keep[:, None, :]
    filled = np.where(both, work, 0.0)
    diagonal = np.arange(p)
    filled[:, diagonal, diagonal] = np.where(keep, filled[:, diagonal, diagonal], 1.0)
    inverse = np.where(both, np.linalg.inv(filled), 0.0)
    return inverse / (safe[:, :, None] * safe[:, None, :]), keep


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1.0) < 1e-14):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def log10_t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """log10 of the two-sided Student-t P, finite for any t."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    t, df = t[ok], df[ok]
    a, b = df / 2.0, np.full(df.shape, 0.5)
    x = df / (df + t * t)
    log_front = _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-np.minimum(x, 1 - 1e-16))
    direct = x < (a + 1.0) / (a + b + 2.0)
    log_p = np.zeros_like(x)
    log_p[direct] = log_front[direct] + np.log(_beta_fraction(a[direct], b[direct], x[direct]) / a[direct])
    rest = ~direct
    swapped = np.exp(log_front[rest]) * _beta_fraction(b[rest], a[rest], 1.0 - x[rest]) / b[rest]
    log_p[rest] = np.log(np.maximum(1.0 - swapped, 1e-300))
    log_p[t == 0] = 0.0
    out[ok] = log_p / LN10
    return out


@F.pandas_udf(T.DoubleType())
def t_neglog10_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """-log10 of the two-sided Student-t P."""
    return pd.Series(-log10_t_tail(t.to_numpy(), df.to_numpy()))


def hardy_weinberg_tail(homs: np.ndarray, hets: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact test P of every row: the chances of all numbers of heterozygotes, relative to the likeliest.

    The recurrence P(h + 2) / P(h) = 4 a b / ((h + 1)(h + 2)), with a and b the
    homozygotes left, runs outward from near the mode for all rows at once, as
    many steps as the longest row needs; a row is done where its terms no
    longer count.
    """
    n = homs + hets + others
    rare = hets + 2 * np.minimum(homs, others)
    mode = np.round(rare * (2 * n - rare) / np.maximum(2 * n, 1)).astype(np.int64)
    mode += (mode + rare) % 2
    mode = np.where(mode > rare, mode - 2, mode)
    total, low = np.ones(len(n)), np.where(hets == mode, 1.0, 0.0)  # sum of all terms; the term of the observed number
    terms: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(len(n)), np.ones(len(n)))]
    for sign in (1, -1):
        at, h, term = np.arange(len(n)), mode.copy(), np.ones(len(n))
        while len(at):
            a, b = (rare[at] - h) / 2.0, (2 * n[at] - rare[at] - h) / 2.0
            if sign > 0:
                term = term * 4.0 * a * b / ((h + 1.0) * (h + 2.0))
            else:
                term = term * h * (h - 1.0) / (4.0 * (a + 1.0) * (b + 1.0))
            h = h + 2 * sign
            go = (h >= 0) & (h <= rare[at]) & (term > 0)
            at, h, term = at[go], h[go], term[go]
            total[at] += term
            low[at] = np.where(h == hets[at], term, low[at])
            terms.append((at, term))
    # Numbers as unlikely as the one observed, or more so.
    tail = np.zeros(len(n))
    for at, term in terms:
        tail[at] += np.where(term <= low[at] * (1 + 1e-9), term, 0.0)
    return np.minimum(tail / total, 1.0)


@F.pandas_udf(T.DoubleType())
def hardy_weinberg_p(n0: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact Hardy-Weinberg P from genotype counts."""
    return pd.Series(hardy_weinberg_tail(*(x.to_numpy().astype(np.int64) for x in (n0, n1, n2))))
