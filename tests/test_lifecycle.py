"""The whole study in one call against its models run one by one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscan.models.api import scan
from cohortscan.models.arrays import SubjectArrays
from cohortscan.operators import pheno as B
from cohortscan.plans import lifecycle, queries_scan
from cohortscan.plans.views import Tables

PATH = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def study(spark):
    t = Tables(spark, PATH)
    prepared = queries_scan.study(t)
    geno = t.cohort_geno().where("POS IN ('1:1000', '2:2000', '3:3000')").cache()
    results = lifecycle.run_manifest(geno, prepared, queries_scan.STUDY_COVARIATES).cache()
    yield geno, prepared, results
    geno.unpersist()
    results.unpersist()


def test_every_manifest_row_has_results(study):
    _, prepared, results = study
    planned = {(r.TYPE, r.DATASET, r.OUTCOME) for r in prepared.manifest.collect()}
    found = {(r.MODEL, r.DATASET, r.OUTCOME) for r in results.select("MODEL", "DATASET", "OUTCOME").distinct().collect()}
    assert planned == {f for f in found if f[0] != "lnmxs_intcp"} and len(planned) > 10
    assert results.where("STATUS IS NULL").count() == 0


@pytest.mark.parametrize("model, table, names", [
    ("coxhm", "survival", queries_scan.STUDY_COVARIATES),
    ("lnmxi", "longitudinal", B.time_covariate(queries_scan.STUDY_COVARIATES)),
])
def test_each_set_equals_its_own_scan(study, model, table, names):
    """One set alone, with the covariates its manifest row lists and no manifest."""
    geno, prepared, results = study
    spec = prepared.manifest.where(f"TYPE = '{model}'").orderBy("DATASET", "OUTCOME").first()
    own = f"DATASET = '{spec.DATASET}' AND OUTCOME = '{spec.OUTCOME}'"
    rows = getattr(prepared, table).where(own)
    alone = {r.POS: r for r in scan(model, geno.where(f"DATASET = '{spec.DATASET}'"), rows, [c for c in names if c in spec.COV]).collect()}
    for r in results.where(f"MODEL = '{model}' AND {own}").collect():
        a = alone[r.POS]
        assert r.STATUS == a.STATUS and r.N_OBS == a.N_OBS
        if r.STATUS == "OK":
            assert r.BETA == pytest.approx(a.BETA, rel=1e-6, abs=1e-9) and r.SE == pytest.approx(a.SE, rel=1e-6)


def test_results_are_pooled_once(study):
    _, prepared, results = study
    from cohortscan.operators import meta

    combined = lifecycle.combine_results(results)
    assert meta.repeated_inputs(combined).count() == 0
    graded = lifecycle.grade(combined, prepared.manifest)
    assert graded.count() > 0 and graded.where("TIER NOT BETWEEN 0 AND 5").count() == 0


def test_arrays_by_subject_give_the_same_results(study):
    """Iterative models on arrays of the same three variants; phenotype rows are sent once for all of them."""
    geno, prepared, results = study
    whole = Tables(geno.sparkSession, PATH).cohort_arrays()
    arrays = SubjectArrays(whole.rows.withColumn("DOSAGES", F.slice("DOSAGES", 1, 3)), whole.variants.where("J < 3"))
    got = lifecycle.run_manifest(geno, prepared, queries_scan.STUDY_COVARIATES, arrays)
    key, shown = ["MODEL", "DATASET", "OUTCOME", "POS", "TERM"], ["BETA", "SE", "NEGLOG10P"]
    a, b = (df.where("MODEL IN ('lgsbl', 'coxhm')").toPandas().set_index(key).sort_index() for df in (got, results))
    assert len(a) and list(a.index) == list(b.index) and list(a.STATUS) == list(b.STATUS) and list(a.N_OBS) == list(b.N_OBS)
    for c in shown:
        assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c
