"""Embedding whitening: blockwise QR, a bidiagonal qd solver, twisted factorisations.

Entries c become whole numbers floor(256 c).  The fit list holds each distinct
vector once.  Every block of it is centred on its own mean and reduced by QR
to a triangle; triangles are merged in groups, with one more row for the
distance of their means, until one triangle R of all centred rows is left, no
larger than dimensions x dimensions.  Householder reflections make R
bidiagonal, the differential quotient-difference algorithm with shifts finds
its singular values, and twisted factorisations of the bidiagonal's normal
matrix give the directions.  A second pass over the fit list measures how far
the whitened covariance is from the identity.

Defined results: a row whose vector is null or holds a null or non-finite
entry is dropped; null and repeated ids and repeated vectors each keep their
row.  Vectors of unequal length are continued with zeros to the longest.
Numbers beyond 64 bits are held at their ends, and a deviation beyond 64 bits
is null.  There are as many components as asked for, fewer where the fit list
varies in fewer directions: none, and so no rows, for an empty table or a
single distinct vector.  Directions of equal variance are any orthogonal ones,
the same for all rows; the largest entry of a direction is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscan.llm.common import lists, pick
from cohortscan.session import checkpointed

COMPONENTS = 4
#: Rows of a block that is reduced at once.
BLOCK = 4096
#: Triangles that one task merges.
FAN = 32
EPS = np.finfo(float).eps
LARGEST = 2.0**63

TRIANGLES = "part long, n long, high array<long>, low array<long>, mean array<double>, r array<double>"


# ------------------------------------------------------------ bidiagonal solver
def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vector v with (I - 2 v v') x along the first axis, and the length it gets there."""
    length = float(np.linalg.norm(x))
    if length == 0.0:
        return np.zeros_like(x), 0.0
    v = x.copy()
    end = -length if x[0] >= 0 else length
    v[0] -= end
    return v / np.linalg.norm(v), end


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor V of r = U B V'."""
    a, d = r.copy(), len(r)
    v = np.eye(d)
    main, upper = np.zeros(d), np.zeros(max(d - 1, 0))
    for k in range(d):
        u, main[k] = reflector(a[k:, k])
        a[k:, k:] -= 2.0 * np.outer(u, u @ a[k:, k:])
        if k < d - 1:
            w, upper[k] = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2.0 * np.outer(v[:, k + 1:] @ w, w)
    return main, upper, v


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential step; nothing when the shift is beyond the least eigenvalue."""
    n = len(q)
    nq, ne = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    for k in range(n - 1):
        if d < 0.0:
            return None
        nq[k] = d + e[k]
        if e[k] == 0.0:
            d = q[k + 1] - shift
        else:
            t = q[k + 1] / nq[k]
            ne[k], d = e[k] * t, d * t - shift
    if d < 0.0 or d != d:
        return None
    nq[-1] = d
    return nq, ne


def least_shift(q: list[float], e: list[float]) -> float:
    """A guess just below the least eigenvalue, from the last two rows."""
    a = q[-2] + (e[-2] if len(q) > 2 else 0.0)
    b2, c = q[-2] * e[-1], q[-1] + e[-1]
    half, mean = (a - c) / 2.0, (a + c) / 2.0
    least = mean - np.hypot(half, np.sqrt(b2))
    coupling = 0.0
    if len(q) > 2:  # how much of that pair's vector leans on the row above it
        lean = abs(c - least) / max(np.hypot(c - least, np.sqrt(b2)), 1e-300)
        coupling = np.sqrt(q[-3] * e[-2]) * min(1.0, lean)
    return max(0.0, least * (1.0 - 4 * EPS) - coupling)


def squared_values(main: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal, falling, by dqds with deflation and splitting."""
    scale = max(np.abs(main).max(initial=0.0), np.abs(upper).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(main))
    blocks = [([(x / scale) ** 2 for x in main], [(x / scale) ** 2 for x in upper], 0.0)]
    found: list[float] = []
    tiny = (16.0 * EPS) ** 2
    while blocks:
        q, e, moved = blocks.pop()
        if q and q[0] < q[-1]:
            q, e = q[::-1], e[::-1]  # values are found from the end, the small ones first
        while q:
            if len(q) == 1:
                found.append(moved + q[0])
                break
            if e[-1] <= tiny * (moved + q[-1]) or e[-1] < 1e-300:
                found.append(moved + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            cut = next((k for k in range(len(e) - 2, -1, -1) if e[k] <= tiny * (moved + min(q[k], q[k + 1])) or e[k] < 1e-300), -1)
            if cut >= 0:
                blocks.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            shift = least_shift(q, e)
            while (step := qd_step(q, e, shift)) is None:
                shift = shift / 4.0 if shift > 1e-18 * q[0] else 0.0
            (q, e), moved = step, moved + shift
    return np.sort(np.maximum(found, 0.0))[::-1] * scale * scale


def twisted_vector(main: np.ndarray, upper: np.ndarray, value: float, avoid: list[np.ndarray]) -> np.ndarray:
    """Unit eigenvector of B'B at ``value``, orthogonal to those in ``avoid``.

    B'B = L D L'.  Its stationary factors from above and progressive factors
    from below meet at each row; where they leave least over, the vector
    follows by two products chains, without a solve.
    """
    floor = EPS * max(np.abs(main).max(), np.abs(upper).max(initial=0.0))
    a = np.where(np.abs(main) < floor, floor, main)
    n, dd = len(a), a * a
    low = upper / a[:-1]
    small = EPS * EPS * dd.max()
    up, s = np.zeros(max(n - 1, 0)), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + dd[i]
        up[i] = dd[i] * low[i] / (pivot if pivot else small)
        s[i + 1] = up[i] * low[i] * s[i] - value
    down, p = np.zeros(max(n - 1, 0)), np.zeros(n)
    p[-1] = dd[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = dd[i] * low[i] ** 2 + p[i + 1]
        t = dd[i] / (pivot if pivot else small)
        down[i], p[i] = low[i] * t, p[i + 1] * t - value
    gap = np.abs(s + p + value)

    def from_twist(r: int) -> np.ndarray:
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -up[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -down[i] * z[i]
        return z / np.linalg.norm(z)

    best, most = None, 0.0
    for r in np.argsort(gap, kind="stable")[: 1 if not avoid else n]:
        z = from_twist(int(r))
        for _ in range(2):
            for other in avoid:
                z = z - (z @ other) * other
        length = float(np.linalg.norm(z))
        if length > most:
            best, most = z / length, length
        if length > 0.5:
            break
    return best


def directions(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The leading right singular vectors of ``r`` (columns), their squared values, and the sum of all.

    Values of a cluster share their accuracy, so its vectors are made
    orthogonal to each other; values that are rounding only are left out.
    """
    main, upper, v = bidiagonal(r)
    squares = squared_values(main, upper)
    noise = (8.0 * EPS * max(len(r), 1)) ** 2 * squares.max(initial=0.0)
    keep = [x for x in squares[:count] if x > noise]
    found: list[np.ndarray] = []
    for i, value in enumerate(keep):
        near = [z for z, other in zip(found, keep) if other - value < 1e-3 * keep[0]]
        found.append(twisted_vector(main, upper, value, near))
    out = v @ np.array(found).T if found else np.zeros((len(r), 0))
    for j in range(out.shape[1]):  # the bidiagonal form is shared, so signs are too
        out[:, j] *= np.sign(out[np.abs(out[:, j]).argmax(), j]) / np.linalg.norm(out[:, j])
    return out, np.array(keep), float((r * r).sum())


# ------------------------------------------------------------- distributed part
def whole_numbers(vector: Column) -> Column:
    """floor(256 c) of each entry."""
    return F.transform(vector, lambda c: F.floor(F.lit(256.0) * c.cast("double")))


def finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of whole numbers, continued with zeros."""
    flat, lengths = lists(column)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, with zero rows below where there are few."""
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, d))
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


@dataclass
class Reduced:
    """Count, sums (in two halves, exact), mean and triangle of some centred rows."""

    n: int
    high: np.ndarray
    low: np.ndarray
    mean: np.ndarray
    r: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Reduced:
        mean = x.mean(axis=0)
        return Reduced(len(x), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), mean, triangle(x - mean))

    def plus(self, other: Reduced) -> Reduced:
        n = self.n + other.n
        apart = other.mean - self.mean
        rows = np.vstack([self.r, other.r, np.sqrt(self.n * (other.n / n)) * apart])
        return Reduced(n, self.high + other.high, self.low + other.low, self.mean + apart * (other.n / n), triangle(rows))

    def batch(self, part: int) -> pa.RecordBatch:
        d = len(self.mean)
        packed = self.r[np.triu_indices(d)]
        return pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([self.n]), *(pa.array([x.astype(np.int64)]) for x in (self.high, self.low)),
             pa.array([self.mean]), pa.array([packed], pa.list_(pa.float64()))],
            ["part", "n", "high", "low", "mean", "r"])

    @staticmethod
    def read(row: dict) -> Reduced:
        mean = np.array(row["mean"], float)
        r = np.zeros((len(mean), len(mean)))
        r[np.triu_indices(len(mean))] = row["r"]
        return Reduced(row["n"], np.array(row["high"], np.int64), np.array(row["low"], np.int64), mean, r)


def reduce_rows(fit_list: DataFrame, width: int) -> Reduced | None:
    """One triangle of all rows of ``fit_list`` (x); none for no rows."""
    def run(batches):
        from pyspark import TaskContext

        total, held, rows = None, [], 0
        for b in batches:
            held.append(matrix(b.column("x"), width))
            rows += len(held[-1])
            if rows >= BLOCK:
                own = Reduced.of(np.vstack(held))
                total, held, rows = own if total is None else total.plus(own), [], 0
        if rows:
            own = Reduced.of(np.vstack(held))
            total = own if total is None else total.plus(own)
        if total is not None:
            yield total.batch(TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["part"])
        total = Reduced.read(rows[0])
        for row in rows[1:]:
            total = total.plus(Reduced.read(row))
        return pa.Table.from_batches([total.batch(rows[0]["part"] // FAN)])

    parts = checkpointed(fit_list.mapInArrow(run, TRIANGLES))
    while parts.count() > FAN:
        group = F.floor(F.col("part") / F.lit(FAN)).cast("long")
        parts = checkpointed(parts.groupBy(group.alias("g")).applyInArrow(merge, TRIANGLES))
    last = sorted(parts.toArrow().to_pylist(), key=lambda x: x["part"])  # FAN triangles at most
    total = None
    for row in last:
        total = Reduced.read(row) if total is None else total.plus(Reduced.read(row))
    return total


@dataclass
class Whitening:
    """Exact count and sums, directions as columns, their variances and shares of all variance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    shares: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([float(s) / self.n for s in self.sums])
        return ((x - mean) @ self.directions) / np.sqrt(self.variances)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2: in 64 bits where they fit, which a float estimate tells; in long integers near the edge."""
        sums = np.array([float(s) for s in self.sums])
        guess = ((float(self.n) * x - sums) ** 2).sum(axis=1)
        wrapped = np.array([s % 2**64 for s in self.sums], np.uint64)
        with np.errstate(over="ignore"):
            apart = np.uint64(self.n % 2**64) * x.astype(np.uint64) - wrapped
            out: list[int | None] = (apart * apart).sum(axis=1, dtype=np.uint64).astype(np.int64).tolist()
        for i in np.flatnonzero(guess > 0.9 * LARGEST):
            exact = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums)) if guess[i] < 1.1 * LARGEST else 2**63
            out[i] = exact if exact < 2**63 else None
        return out


def identity_error(fit_list: DataFrame, model: Whitening, width: int) -> float:
    """Largest absolute entry of the whitened covariance of the fit list less the identity."""
    k = len(model.variances)
    held = fit_list.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        n, total, products = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            z = held.value.project(matrix(b.column("x"), width))
            n, total, products = n + len(z), total + z.sum(axis=0), products + z.T @ z
        if n:  # whitened rows are about one in size and centred up to rounding: their sums do not cancel
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([total]), pa.array([products.ravel()])], ["n", "total", "products"])

    sums = fit_list.mapInArrow(run, "n long, total array<double>, products array<double>")
    def added(column, size):
        return F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(size)]).alias(column)

    row = sums.agg(F.sum("n").alias("n"), added("total", k), added("products", k * k)).first()
    mean = np.array(row["total"]) / row["n"]
    covariance = np.array(row["products"]).reshape(k, k) / row["n"] - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame, int]:
    """Model of the distinct vectors ``x``, the checkpointed fit list and the number of dimensions."""
    fit_list = checkpointed(vectors.select("x").distinct())
    sizes = fit_list.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    width = sizes["most"] or 0
    if sizes["least"] != sizes["most"]:
        zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))
        fit_list = checkpointed(fit_list.select(F.concat("x", zeros).alias("x")).distinct())
    total = reduce_rows(fit_list, width) if width else None
    if total is None:
        return None, fit_list, width
    axes, squares, everything = directions(total.r, components)
    if not len(squares):
        return None, fit_list, width
    sums = [(int(h) << 32) + int(s) for h, s in zip(total.high, total.low)]
    return Whitening(total.n, sums, axes, squares / total.n, squares / everything), fit_list, width


SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened components of every row of ``embeddings`` (vec_id, embedding) with a finite vector."""
    rows = pick(embeddings, "vec_id", "embedding").where(finite(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("x"))
    model, fit_list, width = fit(rows, components)
    if model is None:
        return rows.where(F.lit(False)).select(
            *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMA.split(", ")])
    error = identity_error(fit_list, model, width)
    held = rows.sparkSession.sparkContext.broadcast(model)
    k = len(model.variances)

    def run(batches):
        for b in batches:
            x = matrix(b.column("x"), width)
            z = held.value.project(x)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, held.value.n)),
                 pa.array(held.value.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(z.ravel()), pa.array(np.tile(held.value.shares, m)), pa.array(np.full(m * k, error))],
                [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
