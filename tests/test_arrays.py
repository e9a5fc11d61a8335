"""Fits over several subject blocks and over subject arrays against fits in one block of long rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortscan.models import arrays, cox, logistic, slope
from cohortscan.models.arrays import Block, SubjectArrays
from tests import dense

KEY = ["DATASET", "OUTCOME", "POS", "A1", "A2"]
SHOWN = ["BETA", "SE", "STAT", "N_OBS", "N_GROUP", "N_EVENT"]
COVS = ["X1", "X2"]


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(3)
    rows, visits, geno = [], [], []
    for d, n in (("D0", 120), ("D1", 40)):
        for i in range(n):
            iid, x1, x2 = f"{d}_{i}", rng.normal(), rng.normal()
            dose = [None if rng.random() < 0.06 else float(rng.integers(0, 3)) for _ in range(70)]
            geno += [(d, iid, f"{1 + v % 2}:{1000 * (v + 1)}", "A", "G", v, dose[v]) for v in range(70)]
            for outcome in ("P", "Q"):
                y = int(rng.random() < 1 / (1 + np.exp(-(0.3 * x1 + 0.5 * (dose[0] or 0) - 0.5)))) + 1
                stop = float(rng.integers(1, 15))
                rows.append((d, outcome, iid, x1, x2, y, 0.0, stop, int(rng.random() < 0.4)))
                rows.append((d, outcome, iid, x1 + 0.1, x2, 0, stop, stop + float(rng.integers(1, 9)), int(rng.random() < 0.4)))
            b, u = rng.normal(0, 1), rng.normal(0, 0.5)
            for t in sorted(rng.choice(20, size=rng.integers(2, 6), replace=False) / 4.0):
                visits.append((d, "H", iid, x1, float(t), float(1 + b + (0.3 + u) * t + rng.normal(0, 0.5))))
    long = spark.createDataFrame(geno, "DATASET string, IID string, POS string, A1 string, A2 string, J long, DOSAGE double").cache()
    packed = long.groupBy("DATASET", "IID").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("J", "DOSAGE"))), lambda x: x["DOSAGE"]).alias("DOSAGES"))
    by_subject = SubjectArrays(packed, long.select("J", "POS", "A1", "A2").distinct())
    table = spark.createDataFrame(rows, "DATASET string, OUTCOME string, IID string, X1 double, X2 double, Y int, "
                                        "TSTART double, TSTOP double, EVENT int").cache()
    times = spark.createDataFrame(visits, "DATASET string, OUTCOME string, IID string, X1 double, YEARfDIAG double, Y double").cache()
    yield long.drop("J"), by_subject, table, times
    long.unpersist(), table.unpersist(), times.unpersist()


SCANS = {
    "logistic": lambda g, t, v: logistic.logistic_scan(g, t, COVS),
    "cox": lambda g, t, v: cox.cox_scan(g, t, COVS),
    "slope": lambda g, t, v: slope.random_slope_scan(g, v, ["X1", "YEARfDIAG"]),
}


def collected(df):
    return df.toPandas().set_index(KEY).sort_index()


@pytest.mark.parametrize("name", SCANS)
def test_blocks_and_arrays_equal_one_block(spark, study, monkeypatch, name):
    """D0 is cut into several blocks, D1 stays whole; variants fill two slices."""
    long, by_subject, table, visits = study
    if name == "slope":
        some = ["1:1000", "2:2000", "1:69000", "2:70000"]
        keep = by_subject.variants.where(F.col("POS").isin(some))
        long, by_subject = long.where(F.col("POS").isin(some)), by_subject
    one = collected(SCANS[name](long, table, visits))
    assert len(one) == (2 if name == "slope" else 4) * (4 if name == "slope" else 70) and (one.STATUS == "OK").mean() > 0.9
    calls = []
    whole = arrays.across_blocks
    monkeypatch.setattr(arrays, "BLOCK_SUBJECTS", 45)
    monkeypatch.setattr(arrays, "across_blocks", lambda *a: calls.append(1) or whole(*a))
    several = collected(SCANS[name](long, table, visits))
    if name == "slope":
        by_arrays = one
    else:
        by_arrays = collected(SCANS[name](by_subject, table, visits))
    assert calls
    for other in (several, by_arrays):
        assert list(other.index) == list(one.index) and list(other.STATUS) == list(one.STATUS)
        for c in SHOWN:
            assert np.allclose(other[c].astype(float), one[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_arrays_are_never_spread_to_long_rows(study, spark):
    _, by_subject, table, _ = study
    plan = logistic.logistic_scan(by_subject, table, COVS)._jdf.queryExecution().toString()
    generated = [line for line in plan.split("\n") if "Generate" in line]
    assert generated and all("DOSAGES" not in line or "slice" in line or "BATCH" in line for line in generated)


def test_cox_parts_equal_the_dense_likelihood():
    """Information through row weights equals the sum over event times and tied deaths."""
    rng = np.random.default_rng(8)
    n = 60
    start = rng.integers(0, 5, n).astype(float)
    stop, event = start + rng.integers(1, 6, n), rng.random(n) < 0.5
    x, s = rng.normal(size=(n, 2)), rng.integers(0, 3, (3, n)).astype(float)
    s[1, :7] = np.nan
    fit = cox.CoxFit(["A", "B"])
    block = Block(s, np.arange(n), np.column_stack([start, stop, event, x]), np.unique(stop[event]))
    state = fit.start(3)
    while not state["finished"]:
        state = fit.advance(state, fit.part(state, block))
    got = fit.output(state)
    for v in range(3):
        ok = ~np.isnan(s[v])
        b, se = dense.cox(start[ok], stop[ok], event[ok].astype(int), np.column_stack([s[v, ok], x[ok]]))[:2]
        assert got["B"][v] == pytest.approx(b[0], rel=1e-7) and got["SE"][v] == pytest.approx(se[0], rel=1e-7)
        assert got["N_OBS"][v] == ok.sum() and got["N_EVENT"][v] == event[ok].sum()


def test_sets_without_events_or_variance(spark):
    rows = [("D0", "P", f"i{i}", 0.1 * i, 1.0, 1, 0.0, 1.0 + i, 0) for i in range(6)]
    table = spark.createDataFrame(rows, "DATASET string, OUTCOME string, IID string, X1 double, X2 double, Y int, TSTART double, TSTOP double, EVENT int")
    geno = spark.createDataFrame([("D0", f"i{i}", "1:5", "A", "G", float(i % 2)) for i in range(6)] +
                                 [("D0", f"i{i}", "1:6", "A", "G", None) for i in range(6)],
                                 "DATASET string, IID string, POS string, A1 string, A2 string, DOSAGE double")
    got = cox.cox_scan(geno, table, ["X1"]).collect()
    assert [(r.POS, r.N_OBS, r.N_EVENT, r.STATUS) for r in got] == [("1:5", 6, 0, "NO_VARIANCE")]
    assert pd.isna(got[0].BETA)


class Noted(cox.CoxFit):
    """Remembers the subjects of every run."""

    def part(self, state, block):
        self.runs = [*getattr(self, "runs", []), block.place]
        return super().part(state, block)


def test_sums_are_taken_over_runs_of_whole_subjects(monkeypatch):
    """Also where one subject has more rows than a run; the sums are those of all rows at once."""
    rng = np.random.default_rng(4)
    place = np.repeat(np.arange(9), [3, 1, 4, 12, 2, 2, 1, 5, 3])
    n = len(place)
    start, event = rng.integers(0, 9, n).astype(float), rng.random(n) < 0.5
    stop, x, s = start + rng.integers(1, 6, n), rng.normal(size=(n, 2)), rng.integers(0, 3, (4, 9)).astype(float)
    s[2, 3] = np.nan
    block = Block(s, place, np.column_stack([start, stop, event, x]), np.unique(stop[event]))
    monkeypatch.setattr(arrays, "ROWS_TOGETHER", 6)
    fit = Noted(["A", "B"])
    state = fit.start(4)
    for _ in range(4):
        fit.runs = []
        total = arrays.summed(fit, state, block)
        assert np.array_equal(np.concatenate(fit.runs), place) and len(fit.runs) > 4
        assert all(len(r) <= 6 or len(set(r)) == 1 for r in fit.runs)
        assert all(a[-1] < b[0] for a, b in zip(fit.runs, fit.runs[1:]))
        for k, v in cox.CoxFit(["A", "B"]).part(state, block).items():
            assert np.allclose(total[k], v, rtol=1e-11, atol=1e-11), k
        state = fit.advance(state, total)


def test_blocks_are_bounded_by_rows(study, monkeypatch):
    """Few subjects with many rows are several blocks too, and event times go with a set and not with its rows."""
    _, by_subject, table, _ = study
    one = collected(cox.cox_scan(by_subject, table, COVS))
    calls, packed = [], []
    whole, pack = arrays.across_blocks, arrays.packed_rows
    monkeypatch.setattr(arrays, "BLOCK_ROWS", 170)
    monkeypatch.setattr(arrays, "across_blocks", lambda *a: calls.append(1) or whole(*a))
    monkeypatch.setattr(arrays, "packed_rows", lambda *a: packed.append(pack(*a)) or packed[-1])
    several = collected(cox.cox_scan(by_subject, table, COVS))
    assert calls and list(several.index) == list(one.index)
    for c in SHOWN:
        assert np.allclose(several[c].astype(float), one[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c
    blocks = packed[0].collect()
    assert sum(r.DATASET == "D0" for r in blocks) == 3 and all({g.OUTCOME for g in r.GRIDS} == {"P", "Q"} for r in blocks)
