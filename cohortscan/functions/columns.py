"""Column expressions for tail probabilities, quantiles and variant keys.

Everything stays in the JVM: no user-defined function is involved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cody's rational approximations of the error function (public
# domain), highest power first: near zero, up to four, and beyond.
ERF_NEAR = (
    [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3],
    [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3],
)
ERFC_MIDDLE = (
    [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
     8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3],
    [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
     3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3],
)
ERFC_FAR = (
    [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
     1.60837851487422766e-2, 6.58749161529837803e-4],
    [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2,
     2.33520497626869185e-3],
)

# Acklam's rational approximation of the normal quantile.
QUANTILE_A = [
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
]
QUANTILE_B = [
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01,
]
QUANTILE_C = [
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
]
QUANTILE_D = [
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00,
]
QUANTILE_LOW = 0.02425
CHI2_MEDIAN = 0.454936423119572


def _horner(x: Column, coefficients: list[float]) -> Column:
    """Polynomial with the highest power first."""
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def _ratio(x: Column, parts: tuple[list[float], list[float]]) -> Column:
    return _horner(x, parts[0]) / _horner(x, parts[1])


def log_erfc(x: Column) -> Column:
    """Natural log of erfc(x) for x >= 0, to about 13 digits of erfc; finite however large x gets."""
    square = x * x
    over = F.lit(1.0) / F.greatest(square, F.lit(1.0))
    near = F.log(F.lit(1.0) - x * _ratio(square, ERF_NEAR))
    far = F.log(F.lit(1.0 / math.sqrt(math.pi)) - over * _ratio(over, ERFC_FAR)) - F.log(x)
    return F.when(x <= 0.46875, near).when(x <= 4.0, F.log(_ratio(x, ERFC_MIDDLE)) - square).otherwise(far - square)


def neglog10_p(z: Column) -> Column:
    """-log10 of the two-sided normal P of a z statistic."""
    return -log_erfc(F.abs(z) / F.lit(math.sqrt(2.0))) / F.lit(math.log(10.0))


def two_sided_p(z: Column) -> Column:
    return F.exp(log_erfc(F.abs(z) / F.lit(math.sqrt(2.0))))


def neglog10(p: Column) -> Column:
    """-log10 of a stored P; infinite for P = 0, where only the statistic tells more (``with_neglog10p``)."""
    return F.when(p > 0, -F.log10(p)).when(p == 0, F.lit(float("inf")))


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile for 0 < p < 1 (relative error about 1e-9)."""
    q = p - F.lit(0.5)
    r = q * q
    centre = _horner(r, QUANTILE_A) * q / (_horner(r, QUANTILE_B) * r + F.lit(1.0))
    tail = F.least(p, F.lit(1.0) - p)
    u = F.sqrt(F.lit(-2.0) * F.log(tail))
    edge = _horner(u, QUANTILE_C) / (_horner(u, QUANTILE_D) * u + F.lit(1.0))
    return (
        F.when(tail >= QUANTILE_LOW, centre)
        .when(p < 0.5, edge)
        .otherwise(-edge)
    )


def chi2_1_upper_quantile(p: Column) -> Column:
    """x with P(chi-square, 1 df > x) = p.

    The approximate normal quantile is refined by a Newton step on the exact tail.
    """
    z = F.abs(normal_quantile(p * F.lit(0.5)))
    density = F.exp(z * z * F.lit(-0.5)) / F.lit(math.sqrt(2.0 * math.pi))
    z = z + (two_sided_p(z) - p) * F.lit(0.5) / density
    return z * z


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of chi-square with an integer number of degrees of freedom.

    A finite sum: even df starts from exp(-x/2), odd df from erfc(sqrt(x/2)).
    """
    half = x * F.lit(0.5)
    odd = (df % 2) == 1
    steps = F.floor(df / F.lit(2)).cast("int")
    first = F.when(odd, F.sqrt(x * F.lit(2.0 / math.pi)) * F.exp(-half)).otherwise(F.exp(-half))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        grown = acc["term"] * x / F.when(odd, F.lit(2.0) * k + F.lit(1.0)).otherwise(F.lit(2.0) * k)
        return F.struct(grown.alias("term"), (acc["total"] + acc["term"]).alias("total"))

    series = F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step, lambda acc: acc["total"]
    )
    base = F.when(odd, F.exp(log_erfc(F.sqrt(half)))).otherwise(F.lit(0.0))
    return F.when(df >= 1, base + F.when(steps >= 1, series).otherwise(F.lit(0.0)))


def snap_small(x: Column, eps: float = 1e-10) -> Column:
    return F.when(F.abs(x) < eps, F.lit(0.0)).otherwise(x)


def chromosome(pos: Column) -> Column:
    """Integer chromosome of a ``CHR:BP`` key, with or without ``chr``."""
    return F.regexp_replace(F.split_part(pos, F.lit(":"), F.lit(1)), "^chr", "").try_cast("int")


def base_pair(pos: Column) -> Column:
    return F.regexp_extract(pos, r"^[^:]+:(\d+)", 1).try_cast("long")


def position_range(pos: Column) -> Column:
    """``CHR:BP-BP`` range text of a ``CHR:BP`` key."""
    bp = F.split_part(pos, F.lit(":"), F.lit(2))
    return F.concat(F.split_part(pos, F.lit(":"), F.lit(1)), F.lit(":"), bp, F.lit("-"), bp)


def pack_key(pos: Column, a2: Column, a1: Column) -> Column:
    return F.concat_ws("_", pos, a2, a1)


def unpack_key(key: Column) -> dict[str, Column]:
    """Columns of a packed ``POS_A2_A1`` key."""
    part = F.split(key, "_")
    return {"POS": part.getItem(0), "A2": part.getItem(1), "A1": part.getItem(2)}


def pack_counts(a: Column, b: Column) -> Column:
    return F.concat_ws("_", a.cast("string"), b.cast("string"))


def unpack_counts(packed: Column) -> tuple[Column, Column]:
    part = F.split(packed, "_")
    return part.getItem(0).try_cast("long"), part.getItem(1).try_cast("long")


def variant_label(pos: Column, rsid: Column, gene: Column, gap: str = "") -> Column:
    """``POS[ID] gene`` row label of the cross-tabs."""
    return F.concat(pos, F.lit(gap + "["), rsid, F.lit("] "), gene)


def rounded(x: Column, digits: int = 9) -> Column:
    """Rounded value without a negative zero."""
    r = F.round(x, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)
