"""Plain dense fits, one variant at a time, as independent references."""

from __future__ import annotations

import math

import numpy as np


def ols(x: np.ndarray, y: np.ndarray):
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    df = len(y) - x.shape[1]
    s2 = ((y - x @ b) ** 2).sum() / df
    return b, np.sqrt(s2 * np.diag(inv)), df


def logit(x: np.ndarray, y: np.ndarray):
    b = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ b))
        h = (x * (mu * (1 - mu))[:, None]).T @ x
        b = b + np.linalg.solve(h, x.T @ (y - mu))
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


def cox(start, stop, event, x):
    """Efron ties by an explicit loop over event times."""

    def parts(b):
        r = np.exp(x @ b)
        ll, g, h = 0.0, np.zeros(len(b)), np.zeros((len(b), len(b)))
        for t in np.unique(stop[event == 1]):
            risk, dead = (start < t) & (t <= stop), (stop == t) & (event == 1)
            d = dead.sum()
            ll += (x[dead] @ b).sum()
            g += x[dead].sum(axis=0)
            for k in range(d):
                w = np.where(risk, r, 0) - k / d * np.where(dead, r, 0)
                s0, s1 = w.sum(), w @ x
                s2 = (x * w[:, None]).T @ x
                ll -= math.log(s0)
                g -= s1 / s0
                h += s2 / s0 - np.outer(s1, s1) / s0**2
        return ll, g, h

    b = np.zeros(x.shape[1])
    for _ in range(40):
        _, g, h = parts(b)
        b = b + np.linalg.solve(h, g)
    return b, np.sqrt(np.diag(np.linalg.inv(parts(b)[2])))


def reml(x, y, ids, z_columns, guess):
    """Dense REML with relative covariance factor; Nelder-Mead from numpy only."""
    groups = [np.flatnonzero(ids == i) for i in np.unique(ids)]
    m = z_columns.shape[1]

    def build(par):
        low = np.zeros((m, m))
        low[np.tril_indices(m)] = par
        d = low @ low.T
        inverses, logdet = [], 0.0
        for g in groups:
            v = np.eye(len(g)) + z_columns[g] @ d @ z_columns[g].T
            inverses.append(np.linalg.inv(v))
            logdet += np.linalg.slogdet(v)[1]
        a = sum(x[g].T @ vi @ x[g] for g, vi in zip(groups, inverses))
        c = sum(x[g].T @ vi @ y[g] for g, vi in zip(groups, inverses))
        b = np.linalg.solve(a, c)
        r = y - x @ b
        rss = sum(r[g] @ vi @ r[g] for g, vi in zip(groups, inverses))
        dof = len(y) - x.shape[1]
        return dof * math.log(rss / dof) + logdet + np.linalg.slogdet(a)[1], b, a, rss / dof

    best = nelder_mead(lambda p: build(p)[0], np.asarray(guess, float))
    _, b, a, s2 = build(best)
    return b, np.sqrt(s2 * np.diag(np.linalg.inv(a))), best


def nelder_mead(f, start, steps=4000):
    n = len(start)
    pts = [start] + [start + 0.3 * np.eye(n)[i] for i in range(n)]
    val = [f(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if val[-1] - val[0] < 1e-13 and max(np.abs(p - pts[0]).max() for p in pts) < 1e-8:
            break
        mid = np.mean(pts[:-1], axis=0)
        up = mid + (mid - pts[-1])
        fu = f(up)
        if fu < val[0]:
            far = mid + 2 * (mid - pts[-1])
            ff = f(far)
            pts[-1], val[-1] = (far, ff) if ff < fu else (up, fu)
        elif fu < val[-2]:
            pts[-1], val[-1] = up, fu
        else:
            near = mid + 0.5 * (pts[-1] - mid)
            fn = f(near)
            if fn < val[-1]:
                pts[-1], val[-1] = near, fn
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]


def gee(x, y, ids):
    groups = [np.flatnonzero(ids == i) for i in np.unique(ids)]
    alpha, p = 0.0, x.shape[1]
    for _ in range(200):
        work = [np.linalg.inv((1 - alpha) * np.eye(len(g)) + alpha) for g in groups]
        a = sum(x[g].T @ w @ x[g] for g, w in zip(groups, work))
        b = np.linalg.solve(a, sum(x[g].T @ w @ y[g] for g, w in zip(groups, work)))
        r = y - x @ b
        phi = (r**2).sum() / (len(y) - p)
        cross = sum((r[g].sum() ** 2 - (r[g] ** 2).sum()) / 2 for g in groups)
        pairs = sum(len(g) * (len(g) - 1) / 2 for g in groups)
        alpha = cross / (pairs - p) / phi
    bread = np.linalg.inv(a)
    meat = sum(np.outer(u, u) for u in (x[g].T @ w @ r[g] for g, w in zip(groups, work)))
    return b, np.sqrt(np.diag(bread @ meat @ bread))


def t_two_sided(t: float, df: float) -> float:
    """Two-sided Student-t P by numeric integration."""
    u = np.linspace(0, math.atan(abs(t) / math.sqrt(df)), 200001)
    f = np.cos(u) ** (df - 1)
    total = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 1 - 2 * total * float(((f[1:] + f[:-1]) / 2 * np.diff(u)).sum())
