"""Every model against a dense fit of the same data."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortscan.models import blup, cox, linear, logistic, mixed
from tests import dense

COVS = ["AAO", "YEARfDIAG"]


@pytest.fixture(scope="module")
def study():
    rng = np.random.default_rng(7)
    visits, geno = [], []
    for d in ("D0", "D1"):
        for i in range(70):
            iid = f"{d}_{i}"
            s = rng.integers(0, 3, size=4) * 0.9 + rng.random(4) * 0.2
            for v in range(4):
                geno.append((d, iid, f"1:{v + 1}00", "A", "G", None if rng.random() < 0.05 else float(s[v])))
            base, aao, slope = rng.normal(), rng.normal(60, 8), rng.normal(0, 0.4)
            years = np.sort(rng.choice(40, size=rng.integers(1, 8), replace=False)) / 4.0
            for t in years:
                y = 2 + base + (0.3 + slope) * t + 0.4 * s[0] + 0.2 * s[1] * t + 0.03 * aao + rng.normal() * 0.7
                visits.append((d, "HY", iid, float(round(t * 365)), y, aao, float(t), float(rng.random() < 0.4)))
    return (
        pd.DataFrame(geno, columns=["DATASET", "IID", "POS", "A1", "A2", "DOSAGE"]),
        pd.DataFrame(visits, columns=["DATASET", "OUTCOME", "IID", "TSTART", "Y", "AAO", "YEARfDIAG", "DOPA"]),
    )


@pytest.fixture(scope="module")
def frames(spark, study):
    geno, visits = study
    g = spark.createDataFrame(geno.astype(object).where(geno.notna(), None),
                              "DATASET string, IID string, POS string, A1 string, A2 string, DOSAGE double")
    return g, spark.createDataFrame(visits)


def scaled(rows: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    rows = rows.copy()
    for c in columns:
        rows[c] = rows.groupby("DATASET")[c].transform(lambda x: (x - x.mean()) / x.std())
    return rows


def cells(geno: pd.DataFrame, rows: pd.DataFrame):
    for (d, pos), g in geno.groupby(["DATASET", "POS"]):
        merged = rows[rows.DATASET == d].merge(g.dropna()[["IID", "DOSAGE"]], on="IID")
        yield d, pos, merged


def collected(df) -> pd.DataFrame:
    return df.toPandas().set_index(["DATASET", "POS", "TERM"]).sort_index()


def first_visits(visits: pd.DataFrame) -> pd.DataFrame:
    return visits.sort_values("TSTART").groupby(["DATASET", "IID"], as_index=False).first()


def test_linear(spark, study, frames):
    base = first_visits(study[1])
    got = collected(linear.linear_scan(frames[0], spark.createDataFrame(base), COVS))
    assert len(got) == 8
    for d, pos, m in cells(study[0], scaled(base, COVS)):
        x = np.column_stack([np.ones(len(m)), m.DOSAGE, m[COVS]])
        b, se, df = dense.ols(x, m.Y.to_numpy())
        row = got.loc[(d, pos, "snp")]
        assert row.BETA == pytest.approx(b[1], rel=1e-8) and row.SE == pytest.approx(se[1], rel=1e-8)
        assert row.P == pytest.approx(dense.t_two_sided(b[1] / se[1], df), rel=1e-5)
        assert row.N_OBS == len(m)


def test_plain_linear(spark, study, frames):
    base = first_visits(study[1])
    got = collected(linear.plain_linear_scan(frames[0], spark.createDataFrame(base)))
    for d, pos, m in cells(study[0], base):
        b, se, _ = dense.ols(np.column_stack([np.ones(len(m)), m.DOSAGE]), m.Y.to_numpy())
        assert got.loc[(d, pos, "snp")].BETA == pytest.approx(b[1], rel=1e-8)
        assert got.loc[(d, pos, "snp")].SE == pytest.approx(se[1], rel=1e-7)


def test_logistic(spark, study, frames):
    base = first_visits(study[1])
    base["Y"] = np.where(base.Y > base.Y.median(), 2, 1)
    got = collected(logistic.logistic_scan(frames[0], spark.createDataFrame(base), COVS))
    for d, pos, m in cells(study[0], scaled(base, COVS)):
        x = np.column_stack([np.ones(len(m)), m.DOSAGE, m[COVS]])
        b, se = dense.logit(x, (m.Y == 2).to_numpy(float))
        row = got.loc[(d, pos, "snp")]
        assert row.STATUS == "OK"
        assert row.BETA == pytest.approx(b[1], rel=1e-5, abs=1e-7) and row.SE == pytest.approx(se[1], rel=1e-4)
        assert row.N_EVENT == (m.Y == 2).sum() and row.N_OBS == len(m)


def test_constant_dosage_and_separation(spark, study, frames):
    base = first_visits(study[1])
    base["Y"] = np.where(base.Y > base.Y.median(), 2, 1)
    rows = spark.createDataFrame(base)
    flat = frames[0].selectExpr("DATASET", "IID", "POS", "A1", "A2", "1.0D AS DOSAGE")
    assert set(collected(logistic.logistic_scan(flat, rows, COVS)).STATUS) == {"NO_VARIANCE"}
    assert set(collected(linear.linear_scan(flat, rows, COVS)).STATUS) == {"NO_VARIANCE"}


def test_cox(spark, study, frames):
    rng = np.random.default_rng(3)
    rows = []
    for (d, iid), v in study[1].groupby(["DATASET", "IID"]):
        v = v.sort_values("TSTART")
        t = v.TSTART.to_numpy() - v.TSTART.min()
        for i in range(len(v) - 1):
            event = int(rng.random() < 0.3)
            rows.append((d, "CONST", iid, t[i] // 90 * 90, t[i + 1] // 90 * 90 + 90, event, v.AAO.iloc[i], v.DOPA.iloc[i]))
            if event:
                break
    table = pd.DataFrame(rows, columns=["DATASET", "OUTCOME", "IID", "TSTART", "TSTOP", "EVENT", "AAO", "DOPA"])
    got = collected(cox.cox_scan(frames[0], spark.createDataFrame(table), ["AAO", "DOPA"]))
    for d, pos, m in cells(study[0], scaled(table, ["AAO", "DOPA"])):
        b, se = dense.cox(m.TSTART.to_numpy(), m.TSTOP.to_numpy(), m.EVENT.to_numpy(), m[["DOSAGE", "AAO", "DOPA"]].to_numpy())
        row = got.loc[(d, pos, "snp")]
        assert row.STATUS == "OK"
        assert row.BETA == pytest.approx(b[0], rel=1e-5, abs=1e-7) and row.SE == pytest.approx(se[0], rel=1e-5)
        assert row.N_EVENT == m.EVENT.sum() and row.N_OBS == len(m)


def test_mixed_intercept(spark, study, frames):
    got = collected(mixed.mixed_scan(frames[0], frames[1], COVS))
    for d, pos, m in cells(study[0], scaled(study[1], COVS)):
        x = np.column_stack([np.ones(len(m)), m.DOSAGE, m[COVS]])
        b, se, _ = dense.reml(x, m.Y.to_numpy(), m.IID.to_numpy(), np.ones((len(m), 1)), [1.0])
        row = got.loc[(d, pos, "snp")]
        assert row.BETA == pytest.approx(b[1], rel=1e-5) and row.SE == pytest.approx(se[1], rel=1e-5)
        assert row.N_OBS == len(m) and row.N_GROUP == m.IID.nunique()


def test_mixed_slope_terms(spark, study, frames):
    got = mixed.mixed_scan(frames[0], frames[1], COVS, "YEARfDIAG").toPandas()
    assert set(got.MODEL) == {"lnmxs", "lnmxs_intcp"}
    got = got.set_index(["DATASET", "POS", "TERM"])
    for d, pos, m in cells(study[0], scaled(study[1], COVS)):
        x = np.column_stack([np.ones(len(m)), m.DOSAGE, m[COVS], m.DOSAGE * m.YEARfDIAG])
        b, se, _ = dense.reml(x, m.Y.to_numpy(), m.IID.to_numpy(), np.ones((len(m), 1)), [1.0])
        for term, j in (("snp", 1), ("snp:time", 4)):
            row = got.loc[(d, pos, term)]
            assert row.BETA == pytest.approx(b[j], rel=1e-5, abs=1e-7) and row.SE == pytest.approx(se[j], rel=1e-5)


def test_gee(spark, study, frames):
    got = collected(mixed.gee_scan(frames[0], frames[1], COVS))
    for d, pos, m in cells(study[0], scaled(study[1], COVS)):
        x = np.column_stack([np.ones(len(m)), m.DOSAGE, m[COVS], m.DOSAGE * m.YEARfDIAG])
        b, se = dense.gee(x, m.Y.to_numpy(), m.IID.to_numpy())
        for term, j in (("snp", 1), ("snp:time", 4)):
            row = got.loc[(d, pos, term)]
            assert row.BETA == pytest.approx(b[j], rel=1e-6, abs=1e-8) and row.SE == pytest.approx(se[j], rel=1e-6)


def demeaned(rows: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    rows = rows[rows.groupby(["DATASET", "IID"]).Y.transform("size") > 1].copy()
    for c in columns:
        rows[c] = rows[c] - rows.groupby(["DATASET", "IID"])[c].transform("mean")
    return rows


def test_conditional(spark, study, frames):
    got = collected(linear.conditional_scan(frames[0], frames[1], "YEARfDIAG", ["DOPA"]))
    inner = demeaned(study[1], ["Y", "YEARfDIAG", "DOPA"])
    for (d, pos), g in study[0].groupby(["DATASET", "POS"]):
        g = g.assign(DOSAGE=g.DOSAGE.fillna(g.DOSAGE.mean()))
        m = inner[inner.DATASET == d].merge(g[["IID", "DOSAGE"]], on="IID")
        x, y = m[["YEARfDIAG", "DOPA"]].to_numpy(), m.Y.to_numpy()
        s = (m.DOSAGE * m.YEARfDIAG).to_numpy()
        away = lambda v: v - x @ np.linalg.solve(x.T @ x, x.T @ v)
        sr, yr = away(s), away(y)
        n = len(m) - m.IID.nunique()
        b = sr @ yr / (sr @ sr)
        se = math.sqrt(((yr @ yr) - b * b * (sr @ sr)) / (n - 2 - 2) / (sr @ sr))
        row = got.loc[(d, pos, "snp:time")]
        assert row.BETA == pytest.approx(b, rel=1e-8) and row.SE == pytest.approx(se, rel=1e-8)
        assert row.N_OBS == n


def test_conditional_without_genotypes_of_some(spark, study, frames):
    """Subjects that have no genotype row leave the sums and the counts."""
    keep = sorted(study[0].IID.unique())[::2]
    part = frames[0].where(frames[0].IID.isin([int(i) if str(i).isdigit() else i for i in keep]))
    got = collected(linear.conditional_scan(part, frames[1], "YEARfDIAG", ["DOPA"]))
    want = collected(linear.conditional_scan(part, spark.createDataFrame(study[1][study[1].IID.isin(keep)]), "YEARfDIAG", ["DOPA"]))
    assert len(got) and np.allclose(got.BETA, want.BETA) and np.allclose(got.SE, want.SE) and (got.N_OBS == want.N_OBS).all()


def test_conditional_ignores_constant_and_unlisted_covariates(spark, study, frames):
    plain = collected(linear.conditional_scan(frames[0], frames[1], "YEARfDIAG"))
    flat = collected(linear.conditional_scan(frames[0], frames[1].withColumn("K", F.lit(1.0)), "YEARfDIAG", ["K"]))
    assert np.allclose(plain.SE, flat.SE) and np.allclose(plain.BETA, flat.BETA)
    manifest = spark.createDataFrame([("lncns", d, "HY", []) for d in ("D0", "D1")], "TYPE string, DATASET string, OUTCOME string, COV array<string>")
    unseen = frames[1].withColumn("K", F.lit(None).cast("double"))
    listed = collected(linear.conditional_scan(frames[0], unseen, "YEARfDIAG", ["K"], manifest))
    assert np.allclose(plain.SE, listed.SE) and (plain.N_OBS == listed.N_OBS).all()


def test_gee_returns_every_variant_and_term(spark, study, frames):
    got = mixed.gee_scan(frames[0], frames[1], COVS)
    assert got.count() == 2 * frames[0].select("DATASET", "POS").distinct().count()
    assert got.where("STATUS IS NULL").count() == 0


def test_slope_blup(spark, study, frames):
    from cohortscan.operators.contrast import contrast_matrix

    got = blup.slope_blup(frames[1], "YEARfDIAG", ["DOPA"]).toPandas().set_index("IID").SLOPE
    rows = []
    for (d, iid), v in study[1].sort_values("TSTART").groupby(["DATASET", "IID"]):
        if len(v) > 1:
            rows.append((d, iid, contrast_matrix(len(v)) @ v[["Y", "YEARfDIAG", "DOPA"]].to_numpy()))
    for d in ("D0", "D1"):
        part = [(i, m) for dd, i, m in rows if dd == d]
        stack = np.vstack([m for _, m in part])
        ids = np.concatenate([[i] * len(m) for i, m in part])
        b, _, ratio = dense.reml(stack[:, 2:], stack[:, 0], ids, stack[:, 1:2], [0.5])
        theta = ratio[0] ** 2
        for i, m in part:
            t, r = m[:, 1], m[:, 0] - m[:, 2:] @ b
            assert got[i] == pytest.approx(theta * (t @ r) / (1 + theta * (t @ t)), rel=1e-4, abs=1e-6)


def test_manifest_limits_sets_and_covariates(spark, study, frames):
    base = first_visits(study[1])
    manifest = spark.createDataFrame([("lnsgl", "D0", "HY", ["AAO"])], "TYPE string, DATASET string, OUTCOME string, COV array<string>")
    got = collected(linear.linear_scan(frames[0], spark.createDataFrame(base), COVS, manifest))
    assert set(got.index.get_level_values(0)) == {"D0"}
    for d, pos, m in cells(study[0], scaled(base, ["AAO"])):
        if d == "D0":
            b, se, _ = dense.ols(np.column_stack([np.ones(len(m)), m.DOSAGE, m.AAO]), m.Y.to_numpy())
            assert got.loc[(d, pos, "snp")].SE == pytest.approx(se[1], rel=1e-8)


def test_large_side_takes_the_shuffled_join(spark, study, frames, monkeypatch):
    from cohortscan.models import design

    wide = collected(mixed.mixed_scan(frames[0], frames[1], COVS))
    monkeypatch.setattr(design, "BROADCAST_CELLS", 0)
    again = collected(mixed.mixed_scan(frames[0], frames[1], COVS))
    assert np.allclose(wide.BETA, again.BETA) and np.allclose(wide.SE, again.SE)


def test_random_slope(spark, study, frames):
    from cohortscan.models import slope

    two = frames[0].where("DATASET = 'D0' AND POS IN ('1:100', '1:200')")
    got = collected(slope.random_slope_scan(two, frames[1], COVS, raw_time=False))
    assert len(got) == 2
    for d, pos, m in cells(study[0], scaled(study[1], COVS)):
        if (d, pos, "snp:time") not in got.index:
            continue
        x = np.column_stack([np.ones(len(m)), m.DOSAGE, m[COVS], m.DOSAGE * m.YEARfDIAG])
        z = np.column_stack([np.ones(len(m)), m.YEARfDIAG])
        b, se, _ = dense.reml(x, m.Y.to_numpy(), m.IID.to_numpy(), z, [1.0, 0.0, 0.5])
        row = got.loc[(d, pos, "snp:time")]
        assert row.STATUS == "OK"
        assert row.BETA == pytest.approx(b[4], rel=1e-4, abs=1e-6) and row.SE == pytest.approx(se[4], rel=1e-4)
