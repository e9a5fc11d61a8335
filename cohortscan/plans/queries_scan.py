"""Association scans and sample-structure queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.functions.columns import rounded
from cohortscan.models import blup, cox, linear, logistic, mixed
from cohortscan.models.arrays import SubjectArrays
from cohortscan.operators import genotype as G
from cohortscan.operators import pheno as P
from cohortscan.operators import structure as S
from cohortscan.operators import survival as V
from cohortscan.plans.queries_post import round_columns
from cohortscan.plans.queries_prep import _STATS_SQL, SURVIVAL_CTES
from cohortscan.plans.registry import query
from cohortscan.plans.views import Tables, nlp_sql, rnd, sql_with
from cohortscan.schemas import PCS
from cohortscan.session import checkpointed

COVS = ["AAO", "YEARSEDUC", "FEMALE", "YEARfDIAG"]
EFFECT = ["BETA", "SE", "STAT", "NEGLOG10P"]


def _shown(df: DataFrame, digits: int = 6) -> DataFrame:
    return round_columns(
        df.select("MODEL", "DATASET", "OUTCOME", "POS", "TERM", *EFFECT, "N_OBS", "N_GROUP", "N_EVENT", "STATUS"),
        EFFECT, digits,
    )


def _brief(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return round_columns(df.select("DATASET", "POS", *columns), [c for c in columns if c in EFFECT], digits)


def first_visits(t: Tables) -> DataFrame:
    """One row per subject: the first visit with a measured outcome."""
    rows = t.subject_visits().where(F.col("HY").isNotNull())
    return P.first_rows(rows, ["DATASET", "IID"], ["TSTART"]).withColumns({"OUTCOME": F.lit("HY"), "Y": F.col("HY")})


def visit_rows(t: Tables) -> DataFrame:
    rows = t.subject_visits().where(F.col("HY").isNotNull())
    return rows.withColumns({"OUTCOME": F.lit("HY"), "Y": F.col("HY")})


def case_rows(t: Tables) -> DataFrame:
    """Baseline cases and controls: outcome above 40 at the first visit."""
    return first_visits(t).withColumn("Y", F.when(F.col("HY") > 40, 2).otherwise(1))


_FIRST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY DATASET, IID ORDER BY TSTART) AS rn FROM sv WHERE HY IS NOT NULL) WHERE rn = 1"""



# ----------------------------------------------- SQL of regressions by elimination
def _products(names: list[str], prefix: str = "a", weight: str = "") -> str:
    return ", ".join(
        f"sum({weight}{x} * {y}) AS {prefix}_{x}_{y}" for i, x in enumerate(names) for y in names[i:]
    )


def _eliminate(source: str, names: list[str], pivots: int, keep: str, tag: str) -> tuple[dict[str, str], str]:
    """CTEs that eliminate the leading columns from the packed products.

    Each step also adds the log of its pivot to ``ld``.
    """
    ctes, last = {}, source
    for k in range(pivots):
        p = names[k]
        rest = names[k + 1:]
        cells = ", ".join(
            f"a_{x}_{y} - a_{p}_{x} * a_{p}_{y} / a_{p}_{p} AS a_{x}_{y}" for i, x in enumerate(rest) for y in rest[i:]
        )
        ld = "ln" if k == 0 else "ld + ln"
        ctes[f"{tag}{k}"] = f"SELECT {keep}, {ld}(a_{p}_{p}) AS ld, {cells} FROM {last}"
        last = f"{tag}{k}"
    return ctes, last


_ZC = ["AAO", "YEARSEDUC", "FEMALE", "YEARfDIAG"]


def _scaled_sql(source: str, names: list[str]) -> str:
    z = ", ".join(f"({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w AS z{i}" for i, c in enumerate(names))
    return f"SELECT DATASET, IID, HY AS y, 1.0::DOUBLE AS one, {z} FROM {source} WHERE HY IS NOT NULL WINDOW w AS (PARTITION BY DATASET)"


def _linear_full_sql() -> str:
    names = ["one", "z0", "z1", "z2", "z3", "s", "y"]
    ctes = {
        "f": _FIRST, "zf": _scaled_sql("f", _ZC),
        "d": "SELECT g.POS, DOSAGE AS s, zf.* FROM cgeno g JOIN zf ON g.DATASET = zf.DATASET AND g.IID = zf.IID WHERE DOSAGE IS NOT NULL",
        "m": f"SELECT DATASET, POS, CAST(count(*) AS BIGINT) AS N_OBS, {_products(names)} FROM d GROUP BY 1, 2",
    }
    steps, last = _eliminate("m", names, 5, "DATASET, POS, N_OBS", "w")
    return sql_with("sv cgeno", f"""SELECT DATASET, POS, N_OBS, {rnd('b', 6)} AS BETA, {rnd('se', 6)} AS SE, {rnd('b / se', 6)} AS STAT FROM (SELECT *, a_s_y / a_s_s AS b,
 sqrt((a_y_y - a_s_y * a_s_y / a_s_s) / (N_OBS - 6) / a_s_s) AS se FROM {last})""", **ctes, **steps)


def _conditional_full_sql() -> str:
    names = ["t", "d", "st", "y"]
    ctes = {
        "dm": """SELECT DATASET, IID, YEARfDIAG - avg(YEARfDIAG) OVER w AS t, DOPA - avg(DOPA) OVER w AS d, HY - avg(HY) OVER w AS y,
 count(*) OVER w AS n FROM sv WHERE HY IS NOT NULL WINDOW w AS (PARTITION BY DATASET, IID)""",
        "i": "SELECT DATASET, IID, POS, coalesce(DOSAGE, avg(DOSAGE) OVER (PARTITION BY DATASET, POS)) AS s FROM cgeno",
        "dd": "SELECT i.POS, dm.*, s * t AS st FROM i JOIN dm ON i.DATASET = dm.DATASET AND i.IID = dm.IID WHERE n > 1",
        "m": f"""SELECT DATASET, POS, CAST(count(*) - count(DISTINCT IID) AS BIGINT) AS N_OBS, CAST(count(DISTINCT IID) AS BIGINT) AS N_GROUP,
 {_products(names)} FROM dd GROUP BY 1, 2""",
    }
    steps, last = _eliminate("m", names, 2, "DATASET, POS, N_OBS, N_GROUP", "w")
    return sql_with("sv cgeno", f"""SELECT DATASET, POS, N_OBS, N_GROUP, {rnd('b', 6)} AS BETA, {rnd('se', 6)} AS SE, {rnd(nlp_sql('(b / se)'), 6)} AS NEGLOG10P FROM
 (SELECT *, a_st_y / a_st_st AS b, sqrt((a_y_y - a_st_y * a_st_y / a_st_st) / (N_OBS - 4) / a_st_st) AS se FROM {last})""", **ctes, **steps)


def _mixed_sql(interaction: bool, rounds: int = 5) -> str:
    """Restricted likelihood on narrowing grids of the variance ratio, last a parabola's vertex."""
    fixed = ["one", "z0", "z1", "z2", "z3", "s"] + (["st"] if interaction else [])
    names, p = fixed + ["y"], len(fixed)
    pair = [(x, y) for i, x in enumerate(names) for y in names[i:]]
    ctes = {
        "zv": _scaled_sql("sv", _ZC),
        "d": """SELECT g.POS, DOSAGE AS s, DOSAGE * z3 AS st, zv.* FROM cgeno g JOIN zv ON g.DATASET = zv.DATASET AND g.IID = zv.IID WHERE DOSAGE IS NOT NULL""",
        "tot": f"SELECT DATASET, POS, count(*) AS nobs, count(DISTINCT IID) AS ngrp, {_products(names)} FROM d GROUP BY 1, 2",
        "sub": f"SELECT DATASET, POS, IID, count(*) AS n, {', '.join(f'sum({x}) AS {x}' for x in names)} FROM d GROUP BY 1, 2, 3",
        "bins": f"SELECT DATASET, POS, n, count(*) AS g, {_products(names, 'b')} FROM sub GROUP BY 1, 2, 3",
        "g0": """SELECT DATASET, POS, unnest(list_concat([0.0::DOUBLE], list_transform(range(0, 41), lambda k: exp(ln(1e-4) + k * ln(1e8) / 40)))) AS th FROM tot""",
    }
    step = 18.420680743952367 / 40  # ln(1e8) / 40
    for r in range(rounds + 1):
        cells = ", ".join(f"any_value(t.a_{x}_{y}) - sum(th / (1 + b.n * th) * b.b_{x}_{y}) AS a_{x}_{y}" for x, y in pair)
        ctes[f"e{r}"] = f"""SELECT t.DATASET, t.POS, th, any_value(nobs) AS nobs, any_value(ngrp) AS ngrp, sum(g * ln(1 + b.n * th)) AS lv, {cells}
 FROM g{r} q JOIN tot t ON q.DATASET = t.DATASET AND q.POS = t.POS JOIN bins b ON b.DATASET = t.DATASET AND b.POS = t.POS GROUP BY t.DATASET, t.POS, th"""
        # The interaction term comes last, so both tests can be read off after one elimination.
        steps, last = _eliminate(f"e{r}", names, p - (2 if interaction else 1), "DATASET, POS, th, nobs, ngrp, lv", f"k{r}_")
        ctes |= steps
        if interaction:
            det = "(a_s_s * a_st_st - a_s_st * a_s_st)"
            extra = f"""(a_s_y * a_st_st - a_st_y * a_s_st) / {det} AS b1, (a_st_y * a_s_s - a_s_y * a_s_st) / {det} AS b2,
 a_st_st / {det} AS v1, a_s_s / {det} AS v2, ld + ln({det}) AS dt"""
            rss = "a_y_y - b1 * a_s_y - b2 * a_st_y"
        else:
            extra = "a_s_y / a_s_s AS b1, 0.0 AS b2, 1 / a_s_s AS v1, 0.0 AS v2, ld + ln(a_s_s) AS dt"
            rss = "a_y_y - b1 * a_s_y"
        ctes[f"c{r}"] = f"""SELECT *, (nobs - {p}) * ln(rs / (nobs - {p})) + lv + dt AS crit FROM (SELECT *, {rss} AS rs FROM (SELECT *, {extra} FROM {last}))"""
        ctes[f"t{r}"] = f"""SELECT * FROM (SELECT *, lag(crit) OVER w AS fm, lead(crit) OVER w AS fp FROM c{r} WINDOW w AS (PARTITION BY DATASET, POS ORDER BY th))
 QUALIFY row_number() OVER (PARTITION BY DATASET, POS ORDER BY crit, th) = 1"""
        if r == rounds - 1:
            ctes[f"g{r + 1}"] = f"SELECT DATASET, POS, CASE WHEN th = 0 THEN 0.0 ELSE th * exp({step!r}::DOUBLE * (fm - fp) / (2 * (fm - 2 * crit + fp))) END AS th FROM t{r}"
        elif r < rounds:
            ctes[f"g{r + 1}"] = f"""SELECT DATASET, POS, unnest(CASE WHEN th = 0 THEN [0.0::DOUBLE] ELSE list_transform(range(-10, 11), lambda k: th * exp(k * {step!r}::DOUBLE / 8)) END) AS th FROM t{r}"""
            step = step / 8
    out = []
    for model, term, i in ([("lnmxs_intcp", "snp", 1), ("lnmxs", "snp:time", 2)] if interaction else [("lnmxi", "snp", 1)]):
        out.append(f"""SELECT '{model}' AS MODEL, DATASET, POS, '{term}' AS TERM, CAST(nobs AS BIGINT) AS N_OBS, CAST(ngrp AS BIGINT) AS N_GROUP,
 {rnd(f'b{i}', 3)} AS BETA, {rnd(f'sqrt(rs / (nobs - {p}) * v{i})', 3)} AS SE FROM t{rounds}""")
    return sql_with("sv cgeno", " UNION ALL ".join(out), **ctes)


@query("linear_scan", sql_with("sv cgeno", f"""SELECT DATASET, POS, N_OBS, {rnd('b', 6)} AS BETA, {rnd('sqrt((syy - b * sxy) / (N_OBS - 2) / sxx)', 6)} AS SE,
 {rnd('b / sqrt((syy - b * sxy) / (N_OBS - 2) / sxx)', 6)} AS STAT FROM (SELECT g.DATASET, g.POS, CAST(count(*) AS BIGINT) AS N_OBS,
 regr_slope(HY, DOSAGE) AS b, regr_sxx(HY, DOSAGE) AS sxx, regr_syy(HY, DOSAGE) AS syy, regr_sxy(HY, DOSAGE) AS sxy
 FROM cgeno g JOIN f ON g.DATASET = f.DATASET AND g.IID = f.IID WHERE DOSAGE IS NOT NULL GROUP BY 1, 2)""", f=_FIRST))
def linear_scan(spark, path):
    t = Tables(spark, path)
    return _brief(linear.plain_linear_scan(t.cohort_geno(), first_visits(t)), ["N_OBS", "BETA", "SE", "STAT"])


@query("linear_scan_adjusted", sql_with("sv cgeno", f"""SELECT DATASET, POS, N_OBS, {rnd('b', 6)} AS BETA, {rnd('se', 6)} AS SE, {rnd('b / se', 6)} AS STAT FROM
 (SELECT *, (ssy * scc - ssc * scy) / (sss * scc - ssc * ssc) AS b, sqrt((syy - (ssy * scc - ssc * scy) / (sss * scc - ssc * ssc) * ssy
 - (scy * sss - ssc * ssy) / (sss * scc - ssc * ssc) * scy) / (N_OBS - 3) * scc / (sss * scc - ssc * ssc)) AS se FROM
 (SELECT g.DATASET, g.POS, CAST(count(*) AS BIGINT) AS N_OBS, var_pop(DOSAGE) * count(*) AS sss, var_pop(AAO) * count(*) AS scc, var_pop(HY) * count(*) AS syy,
 covar_pop(DOSAGE, AAO) * count(*) AS ssc, covar_pop(DOSAGE, HY) * count(*) AS ssy, covar_pop(AAO, HY) * count(*) AS scy
 FROM cgeno g JOIN f ON g.DATASET = f.DATASET AND g.IID = f.IID WHERE DOSAGE IS NOT NULL GROUP BY 1, 2))""", f=_FIRST))
def linear_scan_adjusted(spark, path):
    t = Tables(spark, path)
    return _brief(linear.linear_scan(t.cohort_geno(), first_visits(t), ["AAO"]), ["N_OBS", "BETA", "SE", "STAT"])


@query("linear_scan_full", _linear_full_sql())
def linear_scan_full(spark, path):
    t = Tables(spark, path)
    return _brief(linear.linear_scan(t.cohort_geno(), first_visits(t), COVS), ["N_OBS", "BETA", "SE", "STAT"])


_DEMEANED = """SELECT DATASET, IID, YEARfDIAG - avg(YEARfDIAG) OVER w AS t, HY - avg(HY) OVER w AS y, count(*) OVER w AS n FROM sv
 WHERE HY IS NOT NULL WINDOW w AS (PARTITION BY DATASET, IID)"""


def _conditional_sql(geno: str, where: str, **extra: str) -> str:
    return sql_with("sv cgeno", f"""SELECT DATASET, POS, N_OBS, N_GROUP, {rnd('b', 6)} AS BETA, {rnd('se', 6)} AS SE, {rnd(nlp_sql('(b / se)'), 6)} AS NEGLOG10P FROM
 (SELECT *, (sy - st * ty / tt) / (ss - st * st / tt) AS b, sqrt(((yy - ty * ty / tt) - power(sy - st * ty / tt, 2) / (ss - st * st / tt))
 / (N_OBS - 3) / (ss - st * st / tt)) AS se FROM (SELECT i.DATASET, i.POS, sum(s * s * p.pt) AS ss, sum(s * p.pt) AS st, sum(s * p.pty) AS sy, any_value(w.tt) AS tt,
 any_value(w.ty) AS ty, any_value(w.yy) AS yy, any_value(w.N_OBS) AS N_OBS, any_value(w.N_GROUP) AS N_GROUP FROM
 (SELECT DATASET, IID, POS, coalesce(DOSAGE, avg(DOSAGE) OVER (PARTITION BY DATASET, POS)) AS s FROM {geno}) i
 JOIN (SELECT DATASET, IID, sum(t * t) AS pt, sum(t * y) AS pty FROM dm WHERE n > 1 GROUP BY 1, 2) p ON i.DATASET = p.DATASET AND i.IID = p.IID
 JOIN (SELECT DATASET, sum(t * t) AS tt, sum(t * y) AS ty, sum(y * y) AS yy, CAST(count(*) - count(DISTINCT IID) AS BIGINT) AS N_OBS,
 CAST(count(DISTINCT IID) AS BIGINT) AS N_GROUP FROM dm WHERE n > 1 GROUP BY 1) w ON i.DATASET = w.DATASET GROUP BY 1, 2))""", **extra, dm=_DEMEANED.replace("HY IS NOT NULL", f"HY IS NOT NULL{where}"))


@query("conditional_scan", _conditional_sql("cgeno", ""))
def conditional_scan(spark, path):
    t = Tables(spark, path)
    scan = linear.conditional_scan(t.cohort_geno(), visit_rows(t))
    return _brief(scan, ["N_OBS", "N_GROUP", "BETA", "SE", "NEGLOG10P"])


@query("conditional_scan_partial_geno", _conditional_sql(
    "pgeno", " AND IID IN (SELECT IID FROM pgeno)", pgeno="SELECT * FROM cgeno WHERE IID % 3 <> 0"))
def conditional_scan_partial_geno(spark, path):
    """A third of the visited subjects have no genotypes at all; they take no part."""
    t = Tables(spark, path)
    scan = linear.conditional_scan(t.cohort_geno().where(F.col("IID") % 3 != 0), visit_rows(t))
    return _brief(scan, ["N_OBS", "N_GROUP", "BETA", "SE", "NEGLOG10P"])


@query("conditional_scan_full", _conditional_full_sql())
def conditional_scan_full(spark, path):
    t = Tables(spark, path)
    scan = linear.conditional_scan(t.cohort_geno(), visit_rows(t), "YEARfDIAG", ["DOPA"])
    return _brief(scan, ["N_OBS", "N_GROUP", "BETA", "SE", "NEGLOG10P"])


def _solve3(h: str, g: str) -> list[str]:
    """First step of a symmetric 3x3 solve: inverse entries by cofactors."""
    a, b, c, d, e, f = (f"{h}{i}" for i in ("00", "01", "02", "11", "12", "22"))
    det = f"({a}*({d}*{f}-{e}*{e})-{b}*({b}*{f}-{e}*{c})+{c}*({b}*{e}-{d}*{c}))"
    inv = [
        [f"({d}*{f}-{e}*{e})", f"({c}*{e}-{b}*{f})", f"({b}*{e}-{c}*{d})"],
        [f"({c}*{e}-{b}*{f})", f"({a}*{f}-{c}*{c})", f"({b}*{c}-{a}*{e})"],
        [f"({b}*{e}-{c}*{d})", f"({b}*{c}-{a}*{e})", f"({a}*{d}-{b}*{b})"],
    ]
    return ["(" + "+".join(f"{inv[i][j]}*{g}{j}" for j in range(3)) + f")/{det}" for i in range(3)] + [f"{inv[1][1]}/{det}"]


def _logistic_sql(steps: int = 9) -> str:
    z = ["1", "s", "c"]
    ctes = {
        "f": _FIRST,
        "d": """SELECT g.DATASET, g.POS, DOSAGE AS s, (AAO - am) / asd AS c, CASE WHEN HY > 40 THEN 1 ELSE 0 END AS y FROM cgeno g
 JOIN (SELECT *, avg(AAO) OVER (PARTITION BY DATASET) AS am, stddev_samp(AAO) OVER (PARTITION BY DATASET) AS asd FROM f) p
 ON g.DATASET = p.DATASET AND g.IID = p.IID WHERE DOSAGE IS NOT NULL""",
        "b0": "SELECT DISTINCT DATASET, POS, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS v FROM d",
    }
    h = ", ".join(f"sum(mu * (1 - mu) * {z[i]} * {z[j]}) AS h{i}{j}" for i in range(3) for j in range(i, 3))
    g = ", ".join(f"sum((y - mu) * {z[i]}) AS g{i}" for i in range(3))
    sol = _solve3("h", "g")
    for k in range(steps):
        ctes[f"b{k + 1}"] = f"""SELECT DATASET, POS, x0 + {sol[0]} AS x0, x1 + {sol[1]} AS x1, x2 + {sol[2]} AS x2, {sol[3]} AS v FROM
 (SELECT DATASET, POS, any_value(x0) AS x0, any_value(x1) AS x1, any_value(x2) AS x2, {h}, {g} FROM
 (SELECT d.*, x0, x1, x2, 1 / (1 + exp(-(x0 + x1 * s + x2 * c))) AS mu FROM d JOIN b{k} ON d.DATASET = b{k}.DATASET AND d.POS = b{k}.POS) GROUP BY 1, 2)"""
    ctes["n"] = "SELECT DATASET, POS, CAST(count(*) AS BIGINT) AS N_OBS, CAST(sum(y) AS BIGINT) AS N_EVENT FROM d GROUP BY 1, 2"
    return sql_with("sv cgeno", f"""SELECT n.DATASET, n.POS, N_OBS, N_EVENT, {rnd('x1', 5)} AS BETA, {rnd('sqrt(v)', 5)} AS SE
 FROM n JOIN b{steps} b ON n.DATASET = b.DATASET AND n.POS = b.POS""", **ctes)


@query("logistic_scan", _logistic_sql())
def logistic_scan(spark, path):
    t = Tables(spark, path)
    scan = logistic.logistic_scan(t.cohort_geno(), case_rows(t), ["AAO"])
    return _brief(scan, ["N_OBS", "N_EVENT", "BETA", "SE"], 5)


def _solve(source: str, names: list[str], tag: str, units: tuple[str, ...] = ("e",),
           key: tuple[str, ...] = ("DATASET", "POS")) -> tuple[dict[str, str], str]:
    """CTEs of a Gauss-Jordan elimination of [H | g | unit vectors], one column at a time."""
    ctes, last, right = {}, source, [*names, "g", *units]
    keys = ", ".join(key)
    for k in names:
        cells = [f"a_{k}_{j} / a_{k}_{k} AS a_{k}_{j}" for j in right]
        cells += [f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}" for i in names if i != k for j in right]
        ctes[f"{tag}{k}"] = f"SELECT {keys}, {', '.join(cells)} FROM {last}"
        last = f"{tag}{k}"
    return ctes, last


def _logistic_full_sql(rounds: int = 14, covariates: list[str] = _ZC, first: str = _FIRST, together: bool = False,
                       digits: int = 5) -> str:
    """Newton steps from zero, written out; every set of the view converges well before the last."""
    names = ["one", "s", *(f"z{i}" for i in range(len(covariates)))]
    ctes = {
        "f": first, "zf": _scaled_sql("f", covariates).replace("HY AS y", "CASE WHEN HY > 40 THEN 1.0::DOUBLE ELSE 0.0 END AS y"),
        "d": f"""SELECT g.POS, DOSAGE AS s, zf.* FROM cgeno g JOIN zf ON {'' if together else 'g.DATASET = zf.DATASET AND '}g.IID = zf.IID
 WHERE DOSAGE IS NOT NULL""",
        "b0": f"SELECT DATASET, POS, {', '.join(f'0.0::DOUBLE AS b_{n}' for n in names)}, 0.0::DOUBLE AS v FROM d GROUP BY 1, 2",
    }
    eta = " + ".join(f"b_{n} * {n}" for n in names)
    sums = [f"sum(mu * (1 - mu) * {i} * {j}) AS a_{i}_{j}" for i in names for j in names]
    sums += [f"sum({i} * (y - mu)) AS a_{i}_g, {1.0 if i == 's' else 0.0}::DOUBLE AS a_{i}_e" for i in names]
    for r in range(rounds):
        ctes[f"h{r}"] = f"""SELECT DATASET, POS, {', '.join(sums)} FROM (SELECT d.*, 1 / (1 + exp(-({eta}))) AS mu
 FROM d JOIN b{r} b ON d.DATASET = b.DATASET AND d.POS = b.POS) GROUP BY 1, 2"""
        steps, last = _solve(f"h{r}", names, f"j{r}_")
        ctes |= steps
        moved = ", ".join(f"b_{n} + a_{n}_g AS b_{n}" for n in names)
        ctes[f"b{r + 1}"] = f"SELECT b.DATASET, b.POS, {moved}, a_s_e AS v FROM b{r} b JOIN {last} x ON b.DATASET = x.DATASET AND b.POS = x.POS"
    z = "(b_s / sqrt(v))"
    return sql_with("sv cgeno pcs", f"""SELECT 'lgsbl' AS MODEL, b.DATASET, 'HY' AS OUTCOME, b.POS, 'snp' AS TERM, {rnd('b_s', digits)} AS BETA, {rnd('sqrt(v)', digits)} AS SE,
 {rnd(z, digits)} AS STAT, {rnd(nlp_sql(z), digits)} AS NEGLOG10P, n AS N_OBS, n AS N_GROUP, e AS N_EVENT, 'OK' AS STATUS FROM b{rounds} b
 JOIN (SELECT DATASET, POS, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS e FROM d GROUP BY 1, 2) c ON b.DATASET = c.DATASET AND b.POS = c.POS""", **ctes)


@query("logistic_scan_full", _logistic_full_sql())
def logistic_scan_full(spark, path):
    t = Tables(spark, path)
    return _shown(logistic.logistic_scan(t.cohort_arrays(), case_rows(t), COVS), 5)


#: As many covariates as a full study model has: seven clinical ones and five components.
_WIDE = ["AAO", "YEARSEDUC", "FEMALE", "YEARfDIAG", "BLDfDIAG", "FAMILY_HISTORY", "DOPA", *PCS]
_FIRST_WIDE = f"SELECT f.* REPLACE ('ALL' AS DATASET), {', '.join(PCS)} FROM ({_FIRST}) f JOIN pcs ON f.DATASET = pcs.DATASET AND f.IID = pcs.IID"


@query("logistic_scan_wide", _logistic_full_sql(10, _WIDE, _FIRST_WIDE, True, 4))
def logistic_scan_wide(spark, path):
    """All cohorts taken as one, with the covariates of a full study."""
    t = Tables(spark, path)
    rows = case_rows(t).join(t.components(), ["DATASET", "IID"]).withColumn("DATASET", F.lit("ALL"))
    geno = t.cohort_arrays()
    geno = SubjectArrays(geno.rows.withColumn("DATASET", F.lit("ALL")), geno.variants)
    return _shown(logistic.logistic_scan(geno, rows, _WIDE), 4)


def survival_table(t: Tables, carry: list[str]) -> DataFrame:
    return V.build_survival(t.subject_visits(), ["CONST", "SLEEP"], carry)


def _cox_sql(steps: int = 8) -> str:
    """Newton steps for two terms with Efron ties, written out."""
    ctes = dict(SURVIVAL_CTES)
    ctes["k"] = "SELECT DATASET, OUTCOME FROM iv GROUP BY 1, 2 HAVING sum(EVENT) > 19"
    ctes["z"] = """SELECT iv.DATASET, iv.OUTCOME, iv.IID, TSTART, TSTOP, EVENT, (BLDfDIAG - avg(BLDfDIAG) OVER w) / stddev_samp(BLDfDIAG) OVER w AS c
 FROM iv JOIN k ON iv.DATASET = k.DATASET AND iv.OUTCOME = k.OUTCOME WINDOW w AS (PARTITION BY iv.DATASET, iv.OUTCOME)"""
    ctes["d"] = """SELECT z.*, POS, DOSAGE AS s FROM z JOIN cgeno g ON z.DATASET = g.DATASET AND z.IID = g.IID WHERE DOSAGE IS NOT NULL"""
    ctes["ev"] = "SELECT DISTINCT DATASET, OUTCOME, POS, TSTOP AS t FROM d WHERE EVENT = 1"
    ctes["b0"] = "SELECT DISTINCT DATASET, OUTCOME, POS, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS v FROM d"
    key = ["DATASET", "OUTCOME", "POS"]
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in key)
    terms = {"0": "1", "s": "s", "c": "c", "ss": "s * s", "sc": "s * c", "cc": "c * c"}
    risk = ", ".join(f"sum(r * {e}) AS r_{n}, sum(CASE WHEN dead THEN r * {e} ELSE 0 END) AS e_{n}" for n, e in terms.items())
    for k in range(steps):
        ctes[f"r{k}"] = f"""SELECT {', '.join(key)}, t, sum(CASE WHEN dead THEN 1 ELSE 0 END) AS m, sum(CASE WHEN dead THEN s ELSE 0 END) AS zs,
 sum(CASE WHEN dead THEN c ELSE 0 END) AS zc, {risk} FROM (SELECT d.DATASET, d.OUTCOME, d.POS, ev.t, s, c, exp(x0 * s + x1 * c) AS r,
 d.TSTOP = ev.t AND d.EVENT = 1 AS dead FROM ev JOIN d ON {on('ev', 'd')} AND d.TSTART < ev.t AND ev.t <= d.TSTOP
 JOIN b{k} ON {on('d', f'b{k}')}) GROUP BY ALL"""
        w = {n: f"(r_{n} - l * e_{n} / m)" for n in terms}
        ctes[f"h{k}"] = f"""SELECT {', '.join(key)}, sum(CASE WHEN l = 0 THEN zs ELSE 0 END) - sum({w['s']} / {w['0']}) AS gs,
 sum(CASE WHEN l = 0 THEN zc ELSE 0 END) - sum({w['c']} / {w['0']}) AS gc,
 sum({w['ss']} / {w['0']} - power({w['s']} / {w['0']}, 2)) AS hss, sum({w['cc']} / {w['0']} - power({w['c']} / {w['0']}, 2)) AS hcc,
 sum({w['sc']} / {w['0']} - {w['s']} * {w['c']} / power({w['0']}, 2)) AS hsc
 FROM (SELECT *, unnest(range(CAST(m AS BIGINT))) AS l FROM r{k}) GROUP BY ALL"""
        ctes[f"b{k + 1}"] = f"""SELECT {', '.join('h.' + c for c in key)}, x0 + (hcc * gs - hsc * gc) / (hss * hcc - hsc * hsc) AS x0,
 x1 + (hss * gc - hsc * gs) / (hss * hcc - hsc * hsc) AS x1, hcc / (hss * hcc - hsc * hsc) AS v FROM h{k} h JOIN b{k} b ON {on('h', 'b')}"""
    ctes["n"] = f"SELECT {', '.join(key)}, CAST(count(*) AS BIGINT) AS N_OBS, CAST(sum(EVENT) AS BIGINT) AS N_EVENT FROM d GROUP BY ALL"
    return sql_with("sv cgeno", f"""SELECT n.DATASET, n.POS, n.OUTCOME, N_OBS, N_EVENT, {rnd('x0', 5)} AS BETA, {rnd('sqrt(v)', 5)} AS SE
 FROM n JOIN b{steps} b ON {on('n', 'b')}""", **ctes)


@query("cox_scan", _cox_sql())
def cox_scan(spark, path):
    t = Tables(spark, path)
    scan = cox.cox_scan(t.cohort_geno(), survival_table(t, ["BLDfDIAG"]), ["BLDfDIAG"])
    return _brief(scan, ["OUTCOME", "N_OBS", "N_EVENT", "BETA", "SE"], 5)


_COX_COVS = ["BLDfDIAG", "AAO", "FEMALE", "DOPA"]


def _cox_full_sql(rounds: int = 8) -> str:
    """Newton steps of the Efron likelihood: risk sets by an interval join, a line for each tied death."""
    key = ("DATASET", "OUTCOME", "POS")
    keys = ", ".join(key)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in key)
    x = ["s", "c0", "c1", "c2", "c3"]
    pairs = [(a, b) for i, a in enumerate(x) for b in x[i:]]
    cell = {(a, b): f"{a}_{b}" for a, b in pairs} | {(b, a): f"{a}_{b}" for a, b in pairs}
    z = ", ".join(f"(v{i} - avg(v{i}) OVER w) / stddev_samp(v{i}) OVER w AS c{i}" for i in range(4))
    ctes = dict(SURVIVAL_CTES)
    ctes["iv"] = ctes["iv"].replace("TSTART - B AS TSTART", "TSTART AS T0, TSTART - B AS TSTART")
    ctes |= {
        "k": "SELECT DATASET, OUTCOME FROM iv GROUP BY 1, 2 HAVING sum(EVENT) > 19",
        "cv": """SELECT iv.DATASET, iv.OUTCOME, iv.IID, iv.TSTART, iv.TSTOP, iv.EVENT, iv.BLDfDIAG AS v0, sv.AAO AS v1, sv.FEMALE AS v2, sv.DOPA AS v3
 FROM iv JOIN k ON iv.DATASET = k.DATASET AND iv.OUTCOME = k.OUTCOME JOIN sv ON iv.IID = sv.IID AND iv.T0 = sv.TSTART""",
        "z": f"SELECT DATASET, OUTCOME, IID, TSTART, TSTOP, EVENT, {z} FROM cv WINDOW w AS (PARTITION BY DATASET, OUTCOME)",
        "d": "SELECT z.*, POS, DOSAGE AS s FROM z JOIN cgeno g ON z.DATASET = g.DATASET AND z.IID = g.IID WHERE DOSAGE IS NOT NULL",
        "ev": f"SELECT DISTINCT {keys}, TSTOP AS t FROM d WHERE EVENT = 1",
        "b0": f"SELECT DISTINCT {keys}, {', '.join(f'0.0::DOUBLE AS b_{a}' for a in x)}, 0.0::DOUBLE AS v FROM d",
    }
    terms = {"0": "1", **{a: a for a in x}, **{f"{a}_{b}": f"{a} * {b}" for a, b in pairs}}
    sums = ", ".join(f"sum(r * {e}) AS r_{n}, sum(CASE WHEN dead THEN r * {e} ELSE 0 END) AS e_{n}" for n, e in terms.items())
    own = ", ".join(f"sum(CASE WHEN dead THEN {a} ELSE 0 END) AS y_{a}" for a in x)
    w = {n: f"(r_{n} - l * e_{n} / m)" for n in terms}
    cells = [f"sum({w[cell[a, b]]} / {w['0']} - {w[a]} * {w[b]} / power({w['0']}, 2)) AS a_{a}_{b}" for a in x for b in x]
    cells += [f"sum(CASE WHEN l = 0 THEN y_{a} ELSE 0 END) - sum({w[a]} / {w['0']}) AS a_{a}_g, {1.0 if a == 's' else 0.0}::DOUBLE AS a_{a}_e" for a in x]
    for r in range(rounds):
        ctes[f"r{r}"] = f"""SELECT {keys}, t, sum(CASE WHEN dead THEN 1 ELSE 0 END) AS m, {own}, {sums} FROM (SELECT {', '.join('d.' + c for c in key)}, ev.t,
 {', '.join(x)}, exp({' + '.join(f'b_{a} * {a}' for a in x)}) AS r, d.TSTOP = ev.t AND d.EVENT = 1 AS dead
 FROM ev JOIN d ON {on('ev', 'd')} AND d.TSTART < ev.t AND ev.t <= d.TSTOP JOIN b{r} ON {on('d', f'b{r}')}) GROUP BY ALL"""
        ctes[f"h{r}"] = f"SELECT {keys}, {', '.join(cells)} FROM (SELECT *, unnest(range(CAST(m AS BIGINT))) AS l FROM r{r}) GROUP BY ALL"
        steps, last = _solve(f"h{r}", x, f"j{r}_", key=key)
        ctes |= steps
        ctes[f"b{r + 1}"] = f"""SELECT {', '.join('b.' + c for c in key)}, {', '.join(f'b_{a} + a_{a}_g AS b_{a}' for a in x)}, a_s_e AS v
 FROM b{r} b JOIN {last} x ON {on('b', 'x')}"""
    ctes["n"] = f"SELECT {keys}, CAST(count(*) AS BIGINT) AS N_OBS, CAST(count(DISTINCT IID) AS BIGINT) AS N_GROUP, CAST(sum(EVENT) AS BIGINT) AS N_EVENT FROM d GROUP BY ALL"
    score = "(b_s / sqrt(v))"
    return sql_with("sv cgeno", f"""SELECT 'coxhm' AS MODEL, n.DATASET, n.OUTCOME, n.POS, 'snp' AS TERM, {rnd('b_s', 4)} AS BETA, {rnd('sqrt(v)', 4)} AS SE, {rnd(score, 4)} AS STAT,
 {rnd(nlp_sql(score), 4)} AS NEGLOG10P, N_OBS, N_GROUP, N_EVENT, 'OK' AS STATUS FROM n JOIN b{rounds} b ON {on('n', 'b')}""", **ctes)


@query("cox_scan_full", _cox_full_sql())
def cox_scan_full(spark, path):
    t = Tables(spark, path)
    return _shown(cox.cox_scan(t.cohort_arrays(), survival_table(t, _COX_COVS), _COX_COVS), 4)


_MIXED = ["TERM", "N_OBS", "N_GROUP", "BETA", "SE"]


@query("mixed_intercept_scan", _mixed_sql(False))
def mixed_intercept_scan(spark, path):
    t = Tables(spark, path)
    scan = mixed.mixed_scan(t.cohort_geno(), visit_rows(t), COVS)
    return round_columns(scan.select("MODEL", "DATASET", "POS", *_MIXED), ["BETA", "SE"], 3)


@query("mixed_interaction_scan", _mixed_sql(True))
def mixed_interaction_scan(spark, path):
    t = Tables(spark, path)
    scan = mixed.mixed_scan(t.cohort_geno(), visit_rows(t), COVS, "YEARfDIAG")
    return round_columns(scan.select("MODEL", "DATASET", "POS", *_MIXED), ["BETA", "SE"], 3)


def _gee_sql(rounds: int = 16) -> str:
    """Moment rounds on sums by number of visits, then squared scores by subject, all written out."""
    x = ["one", "s", "z0", "z1", "z2", "z3", "st"]
    names = [*x, "y"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    cell = {(a, b): f"{a}_{b}" for a, b in pairs} | {(b, a): f"{a}_{b}" for a, b in pairs}
    ctes = {
        "zs": _scaled_sql("sv", _ZC),
        "d": "SELECT g.POS, DOSAGE AS s, zs.*, DOSAGE * z3 AS st FROM cgeno g JOIN zs ON g.DATASET = zs.DATASET AND g.IID = zs.IID WHERE DOSAGE IS NOT NULL",
        "su": f"""SELECT DATASET, POS, IID, count(*)::DOUBLE AS n, {', '.join(f'sum({a}) AS t_{a}' for a in names)},
 {', '.join(f'sum({a} * {b}) AS p_{a}_{b}' for a, b in pairs)} FROM d GROUP BY 1, 2, 3""",
        "bi": f"""SELECT DATASET, POS, n, count(*)::DOUBLE AS g, {', '.join(f'sum(p_{a}_{b}) AS p_{a}_{b}, sum(t_{a} * t_{b}) AS q_{a}_{b}' for a, b in pairs)}
 FROM su GROUP BY 1, 2, 3""",
        "al0": "SELECT DISTINCT DATASET, POS, 0.0::DOUBLE AS al FROM bi",
    }
    one = {"e": "s", "u": "st"}
    def quadratic(prefix: str) -> str:
        beta = {n: f"(-b_{n})" for n in x} | {"y": "1.0::DOUBLE"}
        return " + ".join(f"{1 if a == b else 2} * {beta[a]} * {beta[b]} * sum({prefix}_{a}_{b})" for a, b in pairs)

    for r in range(rounds + 1):
        weight = "al / (1 + (n - 1) * al)"
        cells = [f"sum(p_{cell[a, b]} - {weight} * q_{cell[a, b]}) AS a_{a}_{b}" for a in x for b in x]
        cells += [f"sum(p_{cell[a, 'y']} - {weight} * q_{cell[a, 'y']}) AS a_{a}_g" for a in x]
        cells += [f"{1.0 if one[u] == a else 0.0}::DOUBLE AS a_{a}_{u}" for a in x for u in one]
        ctes[f"h{r}"] = f"SELECT bi.DATASET, bi.POS, {', '.join(cells)} FROM bi JOIN al{r} w ON bi.DATASET = w.DATASET AND bi.POS = w.POS GROUP BY 1, 2"
        steps, last = _solve(f"h{r}", x, f"j{r}_", tuple(one))
        ctes |= steps
        ctes[f"be{r}"] = f"""SELECT DATASET, POS, {', '.join(f'a_{a}_g AS b_{a}' for a in x)}, {', '.join(f'a_{a}_{u} AS {u}_{a}' for a in x for u in one)} FROM {last}"""
        if r < rounds:
            beta = ", ".join(f"b_{a}" for a in x)
            ctes[f"al{r + 1}"] = f"""SELECT DATASET, POS, (qq - pp) / 2 / (m - {len(x)}) / (pp / (nn - {len(x)})) AS al FROM (SELECT bi.DATASET, bi.POS,
 {quadratic('p')} AS pp, {quadratic('q')} AS qq, sum(g * n * (n - 1) / 2) AS m, sum(g * n) AS nn FROM bi JOIN be{r} b ON bi.DATASET = b.DATASET AND bi.POS = b.POS
 GROUP BY 1, 2, {beta})"""
    rest = {a: f"(p_{cell[a, 'y']} - {' - '.join(f'b_{c} * p_{cell[a, c]}' for c in x)})" for a in x}
    total = f"(t_y - {' - '.join(f'b_{c} * t_{c}' for c in x)})"
    score = {a: f"({rest[a]} - al / (1 + (n - 1) * al) * t_{a} * {total})" for a in x}
    along = {u: " + ".join(f"{u}_{a} * {score[a]}" for a in x) for u in one}
    ctes["me"] = f"""SELECT su.DATASET, su.POS, any_value(b_s) AS b_s, any_value(b_st) AS b_st, sum(power({along['e']}, 2)) AS v_s, sum(power({along['u']}, 2)) AS v_st,
 CAST(sum(n) AS BIGINT) AS nobs, CAST(count(*) AS BIGINT) AS ngrp FROM su JOIN be{rounds} b ON su.DATASET = b.DATASET AND su.POS = b.POS
 JOIN al{rounds} w ON su.DATASET = w.DATASET AND su.POS = w.POS GROUP BY 1, 2"""
    out = []
    for model, term, c in (("lnmxs_intcp", "snp", "s"), ("lnmxs", "snp:time", "st")):
        z = f"(b_{c} / sqrt(v_{c}))"
        out.append(f"""SELECT '{model}' AS MODEL, DATASET, 'HY' AS OUTCOME, POS, '{term}' AS TERM, {rnd(f'b_{c}', 5)} AS BETA, {rnd(f'sqrt(v_{c})', 5)} AS SE,
 {rnd(z, 5)} AS STAT, {rnd(nlp_sql(z), 5)} AS NEGLOG10P, nobs AS N_OBS, ngrp AS N_GROUP, NULL::BIGINT AS N_EVENT, 'OK' AS STATUS FROM me""")
    return sql_with("sv cgeno", " UNION ALL ".join(out), **ctes)


@query("gee_scan", _gee_sql())
def gee_scan(spark, path):
    t = Tables(spark, path)
    return _shown(mixed.gee_scan(t.cohort_geno(), visit_rows(t), COVS), 5)


def _blup_ctes(rounds: int = 5) -> dict[str, str]:
    """Slope predictions: variance ratio on narrowing grids, last a parabola's vertex."""
    ctes = {
        "dm": """SELECT DATASET, IID, YEARfDIAG - avg(YEARfDIAG) OVER w AS t, DOPA - avg(DOPA) OVER w AS d, HY - avg(HY) OVER w AS y,
 count(*) OVER w AS n FROM sv WHERE HY IS NOT NULL WINDOW w AS (PARTITION BY DATASET, IID)""",
        "sb": """SELECT DATASET, IID, count(*) - 1 AS m, sum(t * t) AS tt, sum(t * d) AS td, sum(t * y) AS ty, sum(d * d) AS dd, sum(d * y) AS dy,
 sum(y * y) AS yy FROM dm WHERE n > 1 GROUP BY 1, 2""",
        "g0": """SELECT DATASET, unnest(list_concat([0.0::DOUBLE], list_transform(range(0, 61), lambda k: exp(ln(1e-6) + k * ln(1e12) / 60)))) AS th
 FROM (SELECT DISTINCT DATASET FROM sb)""",
    }
    step = 27.631021115928547 / 60  # ln(1e12) / 60
    for r in range(rounds + 1):
        w = "th / (1 + th * tt)"
        ctes[f"c{r}"] = f"""SELECT *, (n - 1) * ln((yy - dy * dy / dd) / (n - 1)) + lv + ln(dd) AS crit FROM (SELECT g.DATASET, th, sum(m) AS n, sum(ln(1 + th * tt)) AS lv,
 sum(dd - {w} * td * td) AS dd, sum(dy - {w} * td * ty) AS dy, sum(yy - {w} * ty * ty) AS yy FROM g{r} g JOIN sb ON g.DATASET = sb.DATASET GROUP BY 1, 2)"""
        ctes[f"t{r}"] = f"""SELECT * FROM (SELECT *, lag(crit) OVER w AS fm, lead(crit) OVER w AS fp FROM c{r} WINDOW w AS (PARTITION BY DATASET ORDER BY th))
 QUALIFY row_number() OVER (PARTITION BY DATASET ORDER BY crit, th) = 1"""
        if r == rounds - 1:
            ctes[f"g{r + 1}"] = f"SELECT DATASET, CASE WHEN th = 0 THEN 0.0 ELSE th * exp({step!r}::DOUBLE * (fm - fp) / (2 * (fm - 2 * crit + fp))) END AS th FROM t{r}"
        elif r < rounds:
            ctes[f"g{r + 1}"] = f"""SELECT DATASET, unnest(CASE WHEN th = 0 THEN [0.0::DOUBLE] ELSE list_transform(range(-10, 11), lambda k: th * exp(k * {step!r}::DOUBLE / 8)) END) AS th FROM t{r}"""
            step = step / 8
    ctes["bl"] = f"""SELECT sb.DATASET, IID, th / (1 + th * tt) * (ty - td * f.dy / f.dd) AS SLOPE FROM sb JOIN t{rounds} f ON sb.DATASET = f.DATASET"""
    return ctes


# Two digits: where slopes hardly vary the likelihood is flat to rounding around its minimum.
@query("slope_blup", sql_with("sv", f"SELECT DATASET, 'HY' AS OUTCOME, IID, {rnd('SLOPE', 2)} AS SLOPE FROM bl", **_blup_ctes()))
def slope_blup(spark, path):
    t = Tables(spark, path)
    return round_columns(blup.slope_blup(visit_rows(t), "YEARfDIAG", ["DOPA"]), ["SLOPE"], 2)


@query("slope_scan", sql_with("sv cgeno", f"""SELECT DATASET, POS, N_OBS, {rnd('b', 2)} AS BETA, {rnd('sqrt((syy - b * sxy) / (N_OBS - 2) / sxx)', 2)} AS SE
 FROM (SELECT g.DATASET, g.POS, CAST(count(*) AS BIGINT) AS N_OBS, regr_slope(SLOPE, DOSAGE) AS b, regr_sxx(SLOPE, DOSAGE) AS sxx,
 regr_syy(SLOPE, DOSAGE) AS syy, regr_sxy(SLOPE, DOSAGE) AS sxy FROM cgeno g JOIN bl ON g.DATASET = bl.DATASET AND g.IID = bl.IID
 WHERE DOSAGE IS NOT NULL GROUP BY 1, 2)""", **_blup_ctes()))
def slope_scan(spark, path):
    """Linear scan on the predicted slopes."""
    t = Tables(spark, path)
    slopes = blup.slope_blup(visit_rows(t), "YEARfDIAG", ["DOPA"]).withColumnRenamed("SLOPE", "Y")
    return _brief(linear.plain_linear_scan(t.cohort_geno(), slopes), ["N_OBS", "BETA", "SE"], 2)


@query("slopes_by_id", sql_with("sv", f"""SELECT f.DATASET, f.IID, {rnd('SLOPE', 2)} AS SLOPE FROM (SELECT DISTINCT DATASET, IID FROM sv) f
 LEFT JOIN bl ON f.DATASET = bl.DATASET AND f.IID = bl.IID""", **_blup_ctes()))
def slopes_by_id(spark, path):
    """Predicted slopes joined to all subjects; those without a prediction stay, with NULL."""
    t = Tables(spark, path)
    slopes = blup.slope_blup(visit_rows(t), "YEARfDIAG", ["DOPA"]).select("DATASET", "IID", "SLOPE")
    subjects = t.subject_visits().select("DATASET", "IID").distinct()
    return round_columns(subjects.join(slopes, ["DATASET", "IID"], "left"), ["SLOPE"], 2)


# ------------------------------------------------------------------ structure
def calls(t: Tables) -> DataFrame:
    return G.hard_calls(t.cohort_geno())


_LF = "lgamma(({0}) + 1)"


def _hwe_sql() -> str:
    lp = f"k * ln(2.0) - {_LF.format('(rare - k) / 2')} - {_LF.format('k')} - {_LF.format('(2 * called - rare - k) / 2')}"
    return sql_with("geno", f"""SELECT DATASET, POS, N0, N1, N2, {rnd('P', 6)} AS HWE_P FROM (SELECT DATASET, POS, any_value(N0) AS N0, any_value(N1) AS N1,
 any_value(N2) AS N2, any_value(N_MISSING) AS N_MISSING, any_value(N) AS N, sum(CASE WHEN w <= seen + 1e-9 THEN exp(w - top) ELSE 0 END) / sum(exp(w - top)) AS P FROM
 (SELECT *, max(w) OVER (PARTITION BY DATASET, POS) AS top, max(CASE WHEN k = N1 THEN w END) OVER (PARTITION BY DATASET, POS) AS seen FROM
 (SELECT *, {lp} AS w FROM (SELECT *, unnest(range(rare % 2, rare + 1, 2)) AS k FROM (SELECT *, N0 + N1 + N2 AS called,
 N1 + 2 * least(N0, N2) AS rare FROM st)))) GROUP BY 1, 2) WHERE P >= 0.00001 AND N_MISSING * 20 <= N
 AND least(N1 + 2 * N2, N1 + 2 * N0) / (2.0 * (N0 + N1 + N2)) >= 0.05""", st=_STATS_SQL)


@query("hwe_filter", _hwe_sql())
def hwe_filter(spark, path):
    kept = S.array_qc(calls(Tables(spark, path)), ["DATASET", "POS"])
    return round_columns(kept.select("DATASET", "POS", "N0", "N1", "N2", "HWE_P"), ["HWE_P"], 6)


_IBS_MIN = 0.7
#: Every fiftieth sample is there twice, under another id, with some calls lost and some one allele off.
_CHIPS = """SELECT IID, POS, GT FROM geno UNION ALL SELECT IID + 1000000, POS, CASE WHEN (IID + J) % 13 = 0 THEN NULL
 WHEN (IID + J) % 17 = 0 AND GT = 1 THEN 2 ELSE GT END FROM geno WHERE IID % 50 = 0"""


def _ibs_sql() -> str:
    def fall(x: str, k: int) -> str:
        return "(" + " * ".join(["1.0::DOUBLE"] + [f"({x} - {i})" for i in range(k)]) + ")"

    def draw(i: int, j: int) -> str:
        return f"{fall('x', i)} * {fall('y', j)} / {fall('n', i + j)}"

    expect = f"""SELECT avg(2 * {draw(2, 2)}) AS e00, avg(4 * {draw(3, 1)} + 4 * {draw(1, 3)}) AS e01,
 avg({draw(4, 0)} + {draw(0, 4)} + 4 * {draw(2, 2)}) AS e02, avg(2 * {draw(2, 1)} + 2 * {draw(1, 2)}) AS e11,
 avg({draw(3, 0)} + {draw(0, 3)} + {draw(2, 1)} + {draw(1, 2)}) AS e12 FROM (SELECT POS, sum(GT)::DOUBLE AS x, (2 * count(GT) - sum(GT))::DOUBLE AS y,
 (2 * count(GT))::DOUBLE AS n FROM chips GROUP BY 1) WHERE x > 0 AND y > 0 AND n > 3"""
    pairs = """SELECT a.IID AS IID1, b.IID AS IID2, CAST(sum(CASE WHEN abs(a.GT - b.GT) = 2 THEN 1 ELSE 0 END) AS BIGINT) AS IBS0,
 CAST(sum(CASE WHEN abs(a.GT - b.GT) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS IBS1, CAST(sum(CASE WHEN a.GT = b.GT THEN 1 ELSE 0 END) AS BIGINT) AS IBS2
 FROM chips a JOIN chips b ON a.POS = b.POS AND a.IID < b.IID WHERE a.GT IS NOT NULL AND b.GT IS NOT NULL GROUP BY 1, 2"""
    ctes = {
        "chips": _CHIPS, "ex": expect, "pr": pairs, "q0": """SELECT *, IBS0 / (e00 * (IBS0 + IBS1 + IBS2)) AS z0, IBS0 + IBS1 + IBS2 AS m FROM pr, ex""",
        "q1": "SELECT *, (IBS1 - z0 * e01 * m) / (e11 * m) AS z1 FROM q0",
        "q2": "SELECT IID1, IID2, IBS0, IBS1, IBS2, z0, z1, (IBS2 - z0 * e02 * m - z1 * e12 * m) / m AS z2 FROM q1",
    }
    last = "q2"
    for k in range(3):
        vals = ", ".join(f"CASE WHEN z{k} > 1 THEN {1.0 if i == k else 0.0}::DOUBLE ELSE z{i} END AS z{i}" for i in range(3))
        ctes[f"t{k}"] = f"SELECT IID1, IID2, IBS0, IBS1, IBS2, {vals} FROM {last}"
        last = f"t{k}"
    for k in range(3):
        rest = " + ".join(f"z{i}" for i in range(3) if i != k)
        vals = ", ".join(
            f"CASE WHEN z{k} < 0 THEN {'0.0::DOUBLE' if i == k else f'z{i} / CASE WHEN {rest} = 0 THEN 1 ELSE {rest} END'} ELSE z{i} END AS z{i}"
            for i in range(3)
        )
        ctes[f"l{k}"] = f"SELECT IID1, IID2, IBS0, IBS1, IBS2, {vals} FROM {last}"
        last = f"l{k}"
    return sql_with("geno", f"SELECT IID1, IID2, IBS0, IBS1, IBS2, {rnd('z1 / 2 + z2', 6)} AS PI_HAT FROM {last} WHERE z1 / 2 + z2 >= {_IBS_MIN}", **ctes)


@query("ibs_pairs", _ibs_sql())
def ibs_pairs(spark, path):
    """Samples that are on two chips, found by their calls; a sample stays one row throughout."""
    once = Tables(spark, path).call_arrays()
    place = lambda j: F.col("IID") + j
    lost = F.transform("CALLS", lambda gt, j: F.when(place(j) % 13 != 0, F.when((place(j) % 17 == 0) & (gt == 1), F.lit(2).cast("byte")).otherwise(gt)))
    twice = once.where(F.col("IID") % 50 == 0).select(F.col("IID") + 1000000, lost.alias("CALLS"))
    return round_columns(S.related_pairs(checkpointed(once.union(twice)), _IBS_MIN), ["PI_HAT"], 6)


@query("ld_r2_pairs", sql_with("geno", f"""SELECT a.POS AS POS_A, b.POS AS POS_B, CAST(count(*) AS BIGINT) AS N, {rnd('power(corr(a.GT, b.GT), 2)', 6)} AS R2
 FROM geno a JOIN geno b ON a.CHR = b.CHR AND a.IID = b.IID AND a.BP < b.BP WHERE a.GT IS NOT NULL AND b.GT IS NOT NULL GROUP BY 1, 2"""))
def ld_r2_pairs(spark, path):
    pairs, placed = S.ld_pairs(Tables(spark, path).geno().select("IID", "CHR", "BP", "POS", "GT"))
    a = placed.select("CHR", "I", F.col("POS").alias("POS_A"))
    b = placed.select("CHR", F.col("I").alias("J"), F.col("POS").alias("POS_B"))
    return pairs.join(a, ["CHR", "I"]).join(b, ["CHR", "J"]).select(
        "POS_A", "POS_B", "N", rounded(F.col("R") * F.col("R"), 6).alias("R2")
    )


def dense_calls(t: Tables) -> DataFrame:
    """Four variants for each place of the vectors, all on one chromosome: neighbours blend the same two entries."""
    size, k, j = F.size("embedding"), F.col("V") % 4, F.floor(F.col("V") / 4).cast("int")
    spread = t.read("embeddings").select(F.col("vec_id").alias("IID"), "embedding", F.explode(F.sequence(F.lit(0), 4 * size - 1)).alias("V"))
    entry = lambda i: F.get("embedding", F.pmod(i, size)).cast("double")
    x = F.lit(1.0) + F.lit(4.0) * entry(j) + k * F.lit(1.5) * entry(j + 1)
    bp = (F.lit(1000) * (F.col("V") + 1)).cast("long")
    return spread.select("IID", F.lit(1).alias("CHR"), bp.alias("BP"), F.concat(F.lit("1:"), bp.cast("string")).alias("POS"),
                         F.when((F.col("IID") + F.col("V")) % 29 != 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(2.0), x))).cast("int")).alias("GT"))


@query("ld_prune")
def ld_prune(spark, path):
    """Windows of fifty variants, steps of five, inflation of two at most."""
    return S.ld_prune(dense_calls(Tables(spark, path)))


def _pca_sql(k: int = 5, squarings: int = 16) -> str:
    """Eigenvectors of the variants' products by repeated squaring, one after another, then turned into samples' scores."""
    ctes = {
        "gt": "SELECT 'D' || CAST(IID % 5 AS VARCHAR) AS DATASET, IID, J, GT FROM geno WHERE GT IS NOT NULL",
        "fr": "SELECT * FROM (SELECT DATASET, J, avg(GT) / 2 AS f FROM gt GROUP BY 1, 2) WHERE f > 0 AND f < 1",
        "x": "SELECT DATASET, IID, J, (GT - 2 * f) / sqrt(2 * f * (1 - f)) AS X FROM gt JOIN fr USING (DATASET, J)",
        "a0": "SELECT a.DATASET, a.J AS i, b.J AS j, sum(a.X * b.X) AS v FROM x a JOIN x b ON a.DATASET = b.DATASET AND a.IID = b.IID GROUP BY 1, 2, 3",
    }
    for c in range(k):
        last = f"a{c}"
        for r in range(squarings):
            ctes[f"n{c}_{r}"] = f"SELECT DATASET, sum(v * v) AS q FROM {last} GROUP BY 1"
            ctes[f"p{c}_{r}"] = f"""SELECT a.DATASET, a.i, b.j, sum(a.v * b.v) / any_value(q) AS v FROM {last} a JOIN {last} b ON a.DATASET = b.DATASET AND a.j = b.i
 JOIN n{c}_{r} n ON a.DATASET = n.DATASET GROUP BY 1, 2, 3"""
            last = f"p{c}_{r}"
        ctes[f"d{c}"] = f"SELECT DATASET, arg_max(i, v) AS top FROM {last} WHERE i = j GROUP BY 1"
        ctes[f"r{c}"] = f"SELECT DATASET, i, v FROM {last} JOIN d{c} USING (DATASET) WHERE j = top"
        ctes[f"v{c}"] = f"SELECT DATASET, i, v / sqrt(sum(v * v) OVER (PARTITION BY DATASET)) AS v FROM r{c}"
        ctes[f"e{c}"] = f"""SELECT a.DATASET, sum(a.v * l.v * r.v) AS e FROM a{c} a JOIN v{c} l ON a.DATASET = l.DATASET AND a.i = l.i
 JOIN v{c} r ON a.DATASET = r.DATASET AND a.j = r.i GROUP BY 1"""
        ctes[f"a{c + 1}"] = f"""SELECT a.DATASET, a.i, a.j, a.v - e * l.v * r.v AS v FROM a{c} a JOIN v{c} l ON a.DATASET = l.DATASET AND a.i = l.i
 JOIN v{c} r ON a.DATASET = r.DATASET AND a.j = r.i JOIN e{c} e ON a.DATASET = e.DATASET"""
        ctes[f"u{c}"] = f"SELECT x.DATASET, IID, sum(X * v) AS u FROM x JOIN v{c} l ON x.DATASET = l.DATASET AND x.J = l.i GROUP BY 1, 2"
        ctes[f"s{c}"] = f"""SELECT DATASET, IID, u / sqrt(sum(u * u) OVER w) * sign(first_value(u) OVER (PARTITION BY DATASET ORDER BY
 round(abs(u), 9) DESC, IID DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS u FROM u{c} WINDOW w AS (PARTITION BY DATASET)"""
    joins = " ".join(f"JOIN s{c} ON s{c}.DATASET = s0.DATASET AND s{c}.IID = s0.IID" for c in range(1, k))
    return sql_with("geno", f"SELECT s0.DATASET, s0.IID, {', '.join(f'{rnd(f's{c}.u', 4)} AS PC{c + 1}' for c in range(k))} FROM s0 {joins}", **ctes)


@query("pca5", _pca_sql())
def pca5(spark, path):
    """Five components of each cohort's relationship matrix."""
    return round_columns(S.principal_components(calls(Tables(spark, path))), [f"PC{i}" for i in range(1, 6)], 4)


@query("mixed_slope_scan")
def mixed_slope_scan(spark, path):
    from cohortscan.models import slope

    t = Tables(spark, path)
    return _shown(slope.random_slope_scan(t.cohort_arrays(), visit_rows(t), ["AAO", "YEARfDIAG"]), 4)


# ------------------------------------------------------------------ whole study
BINARY, CONTINUOUS, STUDY_COVARIATES = ["CONST", "SLEEP"], ["HY"], ["FEMALE", "YEARSEDUC", "AAO", "BLDfDIAG", "DOPA"]


def study(t: Tables):
    """Model tables of the whole study, with five components of each subject."""
    from cohortscan.plans import lifecycle

    return lifecycle.prepare_visits(t.subject_visits(), t.components(), BINARY, CONTINUOUS, STUDY_COVARIATES)


@query("manifest_to_tiers")
def manifest_to_tiers(spark, path):
    """Phenotypes to graded cells: all models of the manifest, pooled over cohorts."""
    from cohortscan.plans import lifecycle

    t = Tables(spark, path)
    prepared = study(t)
    results = checkpointed(lifecycle.run_manifest(t.cohort_geno(), prepared, STUDY_COVARIATES, t.cohort_arrays()))
    graded = lifecycle.grade(lifecycle.combine_results(results), prepared.manifest)
    return round_columns(graded.select("MODEL", "OUTCOME", "POS", "Effect", "StdErr", "NEGLOG10P", "HetDf", "TIER"),
                         ["Effect", "StdErr", "NEGLOG10P"], 4)


@query("manifest_status")
def manifest_status(spark, path):
    """Results of the manifest's models by set and status."""
    from cohortscan.plans import lifecycle

    t = Tables(spark, path)
    results = lifecycle.run_manifest(t.cohort_geno(), study(t), STUDY_COVARIATES, t.cohort_arrays())
    return results.groupBy("MODEL", "DATASET", "OUTCOME", "TERM", "STATUS").agg(F.count(F.lit(1)).alias("N"))
