"""Within-subject transforms that remove everything constant in time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortscan.functions.columns import snap_small
from cohortscan.operators.ordered import ordinal


def demean(rows: DataFrame, subject: list[str], columns: list[str]) -> DataFrame:
    """Columns less their subject mean, with N_VISITS; single-visit subjects drop out.

    Cross-products of the result equal those of the orthogonal contrast rows,
    so the scans need no more than this.  A subject has one row per visit day.
    """
    own = Window.partitionBy(*subject)
    centred = {c: snap_small(F.col(c) - F.avg(c).over(own)) for c in columns}
    return rows.withColumns({"N_VISITS": F.count(F.lit(1)).over(own), **centred}).where(F.col("N_VISITS") > 1)


def visit_ordinal(rows: DataFrame, subject: list[str], order: str = "TSTART") -> DataFrame:
    return ordinal(rows, subject, [order], F.floor(F.col(order) / F.lit(365.0)), "VISIT")


@lru_cache(maxsize=64)
def contrast_matrix(n: int) -> np.ndarray:
    """(n-1) x n orthonormal polynomial contrasts over 1..n.

    The orthonormal polynomials on equally spaced points are the eigenvectors
    of their tridiagonal recurrence matrix, which stays exact for any n.
    """
    k = np.arange(1, n, dtype=float)
    off = np.sqrt(k * k * (n * n - k * k) / (4.0 * (4.0 * k * k - 1.0)))
    jacobi = np.diag(off, 1) + np.diag(off, -1)
    _, vectors = np.linalg.eigh(jacobi)
    vectors = vectors * np.sign(vectors[0])
    return vectors[1:]


def contrast_rows(rows: DataFrame, subject: list[str], order: str, columns: list[str]) -> DataFrame:
    """n visits to n-1 contrast rows per subject (row-level export form).

    A group is one subject's visits, at most one per day.
    """
    fields = rows.select(*subject).schema.fields
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    schema += ", CONTRAST int, " + ", ".join(f"{c} double" for c in columns)

    def transform(key: tuple, visits: pd.DataFrame) -> pd.DataFrame:
        visits = visits.sort_values(order)
        n = len(visits)
        if n < 2:
            return pd.DataFrame({c: [] for c in subject + ["CONTRAST"] + columns})
        values = contrast_matrix(n) @ visits[columns].to_numpy(dtype=float)
        values[np.abs(values) < 1e-10] = 0.0
        out = pd.DataFrame(values, columns=columns)
        out.insert(0, "CONTRAST", np.arange(1, n, dtype="int32"))
        for i, c in enumerate(subject):
            out.insert(i, c, [key[i]] * (n - 1))
        return out

    return rows.select(*dict.fromkeys([*subject, order, *columns])).groupBy(*subject).applyInPandas(
        transform, schema
    )
