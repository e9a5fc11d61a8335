from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscan.functions import columns as C
from cohortscan.functions import numeric as N
from cohortscan.operators import assoc as A
from cohortscan.operators import bounded, contrast, genotype, ids, manifest, meta, ordered, pheno, post, scores, structure, survival
from tests import dense


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ------------------------------------------------------------------ functions
def test_normal_tail_and_quantile(spark):
    zs = [0.0, 0.3, -1.0, 2.5, -5.0, 8.0, 20.0, 60.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", C.neglog10_p(F.col("z")).alias("n"))
    for z, n in rows(df):
        if abs(z) < 30:
            assert n == pytest.approx(-math.log10(math.erfc(abs(z) / math.sqrt(2))), abs=1e-6)
        else:
            assert math.isfinite(n) and n > 700
    ps = [1e-9, 0.01, 0.02425, 0.3, 0.5, 0.8, 0.999]
    q = spark.createDataFrame([(p,) for p in ps], "p double").select("p", C.normal_quantile(F.col("p")).alias("q"))
    for p, got in rows(q):
        assert got == pytest.approx(NormalDist().inv_cdf(p), rel=1e-8, abs=1e-8)


def test_chi2_tail(spark):
    df = spark.createDataFrame([(x, d) for x in (0.0, 0.5, 3.0, 20.0) for d in range(0, 13)], "x double, d long")
    for x, d, got in rows(df.select("x", "d", C.chi2_sf(F.col("x"), F.col("d")).alias("p"))):
        if d == 0:
            assert got is None
            continue
        u = np.linspace(x, x + 400, 400001)[1:]
        f = u ** (d / 2 - 1) * np.exp(-u / 2) / 2 ** (d / 2) / math.gamma(d / 2)
        want = 1.0 if x == 0 else float(((f[1:] + f[:-1]) / 2 * np.diff(u)).sum())
        assert got == pytest.approx(want, abs=5e-3 if d == 1 else 1e-3)
    assert C is not None


def test_t_tail():
    for t, d in ((0.0, 5), (1.2, 3), (-2.5, 40), (6.0, 200)):
        assert 10 ** N.log10_t_tail(np.array([t]), np.array([d]))[0] == pytest.approx(dense.t_two_sided(t, d), rel=1e-6)
    assert N.log10_t_tail(np.array([1e6]), np.array([300.0]))[0] < -300


def test_keys(spark):
    df = spark.createDataFrame([("chr3:77",), ("12:9",)], "p string")
    got = rows(df.select(C.chromosome(F.col("p")), C.base_pair(F.col("p")), C.position_range(F.col("p"))))
    assert got == [(3, 77, "chr3:77-77"), (12, 9, "12:9-9")]
    packed = spark.range(1).select(C.pack_key(F.lit("1:5"), F.lit("G"), F.lit("A")).alias("k"), C.pack_counts(F.lit(3), F.lit(4)).alias("c"))
    k = C.unpack_key(F.col("k"))
    assert rows(packed.select(k["POS"], k["A2"], k["A1"], *C.unpack_counts(F.col("c")))) == [("1:5", "G", "A", 3, 4)]
    assert genotype.qc_label(0.001, 0.3) == "maf001rsq3" and genotype.qc_label(0.05, 0.8) == "maf05rsq8"


# ------------------------------------------------------- order and hot groups
def hot(spark, n=3000):
    """A third of the rows share one key, and many share one value."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("v"), "id",
    )


def test_global_rank_and_ordinal_match_a_plain_window(spark):
    from pyspark.sql import Window

    df = hot(spark)
    w = Window.partitionBy("k").orderBy("v", "id")
    want = rows(df.withColumn("r", F.row_number().over(w).cast("long")))
    assert rows(ordered.global_rank(df, ["k"], ["v", "id"], "r").select("k", "v", "id", "r")) == want
    assert rows(ordered.ordinal(df, ["k"], ["v", "id"], F.floor("v"), "r").select("k", "v", "id", "r")) == want


def test_exact_median(spark):
    df = hot(spark)
    want = rows(df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.lit(0.5)).alias("m")))
    for bins in (4, 1 << 16):
        assert rows(ordered.exact_median(df, ["k"], F.col("v"), bins)) == want


def test_join_small_equals_a_salted_join(spark):
    df = hot(spark)
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    near = bounded.join_small(df, stats, ["k"], "inner")
    far = bounded.salted_join(df, stats, ["k"], "inner")
    assert rows(near.select("k", "id", "n")) == rows(far.select("k", "id", "n")) and near.count() == 3000
    assert bounded.join_small(df, stats.where("k = 'hot'"), ["k"], "left_semi").count() == 1000
    with pytest.raises(ValueError):
        bounded.salted_join(df, stats, ["k"], "full")


# ------------------------------------------------------------------ survival
# Visit histories and the intervals they must give.
GOLDEN = [
    ("mid", [(0, 0), (180, 0), (365, 1), (730, 1)], [(0, 180, 0), (180, 365, 1)], 0.0),
    ("never", [(0, 0), (200, 0), (400, 0)], [(0, 200, 0), (200, 400, 0)], 0.0),
    ("first", [(0, 1), (200, 1)], [], 0.0),
    ("gap", [(0, 0), (100, None), (200, 1)], [(0, 100, 0), (100, 200, 1)], 0.0),
    ("nullfirst", [(0, None), (100, 0), (300, 1)], [(0, 200, 1)], 100 / 365.25),
    ("late", [(50, 0), (250, 0)], [(0, 200, 0)], 50 / 365.25),
    ("trailing", [(0, 0), (100, 0), (200, None)], [(0, 100, 0)], 0.0),
    ("allnull", [(0, None), (100, None)], [], 0.0),
    ("double", [(0, 0), (100, 0), (100, 1), (200, 1)], [(0, 100, 1)], 0.0),
]


def test_survival_golden_rows(spark):
    data = [("D", name, float(t), s, 1.0) for name, visits, _, _ in GOLDEN for t, s in visits]
    visits = spark.createDataFrame(data, "DATASET string, IID string, TSTART double, CONST int, BLDfDIAG double")
    long = survival.long_outcomes(visits, ["CONST"], ["BLDfDIAG"])
    got: dict = {}
    for r in survival.intervals(long).orderBy("IID", "TSTART").collect():
        got.setdefault(r.IID, []).append((r.TSTART, r.TSTOP, r.EVENT, round(r.BLDfDIAG - 1.0, 9)))
    for name, _, want, shift in GOLDEN:
        assert got.get(name, []) == [(*w, round(shift, 9)) for w in want], name


def test_frequent_events(spark):
    data = [("D", "CONST", f"i{i}", 0.0, 10.0, 1) for i in range(20)] + [("D", "RBD", f"i{i}", 0.0, 10.0, 1) for i in range(19)]
    table = spark.createDataFrame(data, "DATASET string, OUTCOME string, IID string, TSTART double, TSTOP double, EVENT int")
    assert {r.OUTCOME for r in survival.frequent_events(table).select("OUTCOME").distinct().collect()} == {"CONST"}


def test_contrasts_span_the_complement_of_the_mean():
    for n in (2, 3, 7, 60):
        m = contrast.contrast_matrix(n)
        assert np.allclose(m @ m.T, np.eye(n - 1)) and np.allclose(m.sum(axis=1), 0)
        assert (np.diff(m[0]) > 0).all()


# ------------------------------------------------------------------ phenotypes
def test_phenotype_tables(spark):
    data = []
    for i in range(30):
        for t in (0.0, 200.0):
            data.append(("A", f"a{i}", t, i % 2, 1.0 * i, 60.0 + i, 2.0 if t == 0 else None))
        data.append(("B", f"b{i}", 10.0, 1, 5.0 + i, 50.0, None))
    visits = spark.createDataFrame(data, "DATASET string, IID string, TSTART double, CONST int, HY double, AAO double, MMSE double")
    visits = visits.withColumns({"FEMALE": F.lit(1), "BLDfDIAG": F.col("AAO") / 10, "YEARfDIAG": F.col("AAO") / 10 + F.col("TSTART")})
    comps = spark.createDataFrame([("A", f"a{i}", 0.1 * i) for i in range(30)] + [("A", "a1", 9.0)], "DATASET string, IID string, PC1 double")
    rules = ids.CohortRules(without_baseline=("B",))
    table, specs = pheno.build_baseline(visits, comps, ["CONST"], ["FEMALE", "AAO", "BLDfDIAG"], rules, more_than=14)
    assert rows(specs) == [("lgsbl", "A", "CONST", ["AAO", "BLDfDIAG"])] or rows(specs)[0][:3] == ("lgsbl", "A", "CONST")
    assert table.where("DATASET = 'A'").count() == 30 and table.where("IID = 'a1'").first().PC1 == pytest.approx(0.1)
    longit, more = pheno.build_longitudinal(visits, comps, ["HY", "MMSE"], ["FEMALE", "AAO", "BLDfDIAG"])
    kinds = {(r.TYPE, r.DATASET, r.OUTCOME): r.COV for r in more.collect()}
    assert set(kinds) == {("lnmxi", "A", "HY"), ("lnmxs", "A", "HY"), ("lncns", "A", "HY"), ("lnmxi", "B", "HY"), ("lnmxs", "B", "HY"), ("lncns", "B", "HY")}
    assert kinds[("lncns", "A", "HY")] == ["YEARfDIAG"] and "FEMALE" not in kinds[("lnmxi", "A", "HY")]
    assert longit.where("OUTCOME = 'HY' AND DATASET = 'A'").count() == 60
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert pheno.nan_to_null(nan, ["x"]).agg(F.avg("x")).first()[0] == 1.0


def test_seadl70(spark):
    df = pheno.derive_seadl70(spark.createDataFrame([(70.0,), (80.0,), (None,)], "SEADL double"))
    assert {r.SEADL: r.SEADL70 for r in df.collect()} == {70.0: 1, 80.0: 0, None: None}


# ------------------------------------------------------------------ pooling
def assoc(spark, data):
    return spark.createDataFrame(data, "MODEL string, OUTCOME string, DATASET string, POS string, A1 string, A2 string, BETA double, SE double, ALT_FRQ double")


def test_meta_invariants(spark):
    one = ("m", "o", "D0", "1:1", "A", "G", 0.4, 0.1, 0.2)
    single = meta.meta_fixed(assoc(spark, [one])).first()
    assert (single.Effect, single.StdErr, single.HetDf, single.HetISq, single.Direction) == (pytest.approx(0.4), pytest.approx(0.1), 0, 0.0, "+")
    twice = meta.meta_fixed(assoc(spark, [one, ("m", "o", "D1", *one[3:])])).first()
    assert twice.Effect == pytest.approx(0.4) and twice.StdErr == pytest.approx(0.1 / math.sqrt(2)) and twice.HetChiSq == pytest.approx(0, abs=1e-9)
    other = ("m", "o", "D1", "1:1", "A", "G", -0.1, 0.2, 0.3)
    flipped = ("m", "o", "D1", "1:1", "G", "A", 0.1, 0.2, 0.7)
    a, b = (meta.meta_fixed(assoc(spark, [one, x])).first() for x in (other, flipped))
    for c in ("Effect", "StdErr", "P", "Freq1", "HetISq", "HetPVal", "Direction"):
        assert a[c] == pytest.approx(b[c]) if isinstance(a[c], float) else a[c] == b[c]
    w = np.array([100.0, 25.0])
    eff = (w * [0.4, -0.1]).sum() / w.sum()
    q = (w * (np.array([0.4, -0.1]) - eff) ** 2).sum()
    assert a.Effect == pytest.approx(eff) and a.HetChiSq == pytest.approx(q) and a.HetISq == pytest.approx(100 * (q - 1) / q)
    assert a.HetPVal == pytest.approx(math.erfc(math.sqrt(q / 2)), abs=1e-6) and a.Direction == "+-"
    no_freq = meta.meta_fixed(assoc(spark, [one, other]).drop("ALT_FRQ")).first()
    assert no_freq.Freq1 is None and no_freq.Effect == pytest.approx(eff)
    assert meta.to_pooled_layout(meta.meta_fixed(assoc(spark, [one]))).columns[0] == "MarkerName"


def test_direction_covers_only_the_cohorts_of_the_test(spark):
    data = [("m", "o1", "D0", "1:1", "A", "G", 0.4, 0.1, 0.2), ("m", "o1", "D2", "1:2", "A", "G", -0.4, 0.1, 0.2), ("m", "o2", "D1", "1:1", "A", "G", 0.4, 0.1, 0.2)]
    got = {(r.OUTCOME, r.POS): r.Direction for r in meta.meta_fixed(assoc(spark, data)).collect()}
    assert got == {("o1", "1:1"): "+?", ("o1", "1:2"): "?-", ("o2", "1:1"): "+"}


def test_filter_rules(spark):
    counts = spark.createDataFrame([("m", "o", 5, 2)], "MODEL string, OUTCOME string, N_COHORTS long, THRESHOLD long")
    table = spark.createDataFrame(
        [("m", "o", "a", 2, 10.0, 0.1, 0.2, 0.15), ("m", "o", "b", 3, 10.0, 0.1, 0.3, 0.2), ("m", "o", "c", 3, 90.0, 0.1, 0.2, 0.2), ("m", "o", "d", 1, 0.0, 0.1, 0.1, 0.1)],
        "MODEL string, OUTCOME string, POS string, HetDf long, HetISq double, MinFreq double, MaxFreq double, Freq1 double")
    kept = lambda rule: {r.POS for r in meta.filter_meta(table, counts, rule).collect()}
    assert (kept("a"), kept("b"), kept("c")) == ({"b"}, {"a", "b"}, {"a"})


def test_harmonise_keeps_p_and_size(spark):
    df = assoc(spark, [("m", "o", "D0", "1:1", "A", "G", 0.4, 0.1, 0.8), ("m", "o", "D0", "1:2", "A", "G", 0.4, 0.1, 0.5)])
    got = {r.POS: r for r in A.to_minor_allele(df).collect()}
    assert (got["1:1"].BETA, got["1:1"].MINOR_ALLELE, got["1:1"].MAF) == (-0.4, "G", pytest.approx(0.2))
    assert (got["1:2"].BETA, got["1:2"].MINOR_ALLELE) == (0.4, "A")
    bounded_ = A.keep_bounded_effects(df.withColumns({"BETA": F.lit(7.0), "OUTCOME": F.when(F.col("POS") == "1:1", "MMSE").otherwise("HY")}))
    assert [r.POS for r in bounded_.collect()] == ["1:1"]
    assert rows(A.swap_alleles(df).select("A1", "A2").distinct()) == [("G", "A")]


def test_unknown_frequency_has_no_orientation(spark):
    df = assoc(spark, [("m", "o", "D0", "1:1", "A", "G", 0.4, 0.1, None)])
    got = A.to_minor_allele(df).first()
    assert got.BETA is None and got.MINOR_ALLELE is None and got.MAJOR_ALLELE is None and got.MAF is None


def test_a_cohort_is_pooled_once(spark):
    both = [(m, "o", d, "1:1", "A", "G", b, 0.1, 0.2) for d, m, b in (
        ("D0", "lnmxs_intcp", 0.1), ("D0", "lnmxi", 0.9), ("D1", "lnmxi", 0.2), ("D1", "lnsgl", 0.9), ("D2", "lnsgl", 0.3))]
    table = assoc(spark, both)
    folded = A.fold_models(table)
    assert {(r.DATASET, r.BETA) for r in folded.collect()} == {("D0", 0.1), ("D1", 0.2), ("D2", 0.3)}
    assert meta.repeated_inputs(folded).count() == 0
    assert meta.repeated_inputs(folded.unionByName(folded.where("DATASET = 'D0'"))).first().N == 2
    pooled = meta.meta_fixed(folded).first()
    assert pooled.HetDf == 2 and pooled.StdErr == pytest.approx(0.1 / 3**0.5)


def test_tiers_and_fixed_cuts(spark):
    nlp = [(f"1:{i}", "m", "o", float(i)) for i in range(0, 9)] + [("1:0", "m", "p", None)]
    table = spark.createDataFrame(nlp, "POS string, MODEL string, OUTCOME string, NEGLOG10P double")
    got = {(r.POS, r.OUTCOME): r.TIER for r in post.tiers(table).collect()}
    levels = [got[(f"1:{i}", "o")] for i in range(9)]
    assert levels == sorted(levels) and levels[0] == 1 and levels[-1] == 5 and got[("1:0", "p")] == 0
    fixed = {r.POS: r.TIER for r in post.fixed_tiers(table.where("OUTCOME = 'o'")).collect()}
    assert [fixed[f"1:{i}"] for i in range(6)] == [1, 1, 2, 3, 4, 5]


def test_lambda_is_one_for_uniform_p(spark):
    n = 2001
    df = spark.range(1, n + 1).select(F.lit("m").alias("MODEL"), F.lit("o").alias("OUTCOME"), (F.col("id") / (n + 1)).alias("P"))
    assert post.lambda_gc(df).first().LAMBDA == pytest.approx(1.0, abs=1e-9)


def test_manhattan_only_when_calibrated(spark):
    df = spark.createDataFrame([("m", "o", f"{c}:{b}", 0.5, 0.3) for c in (1, 2) for b in (10, 20)] + [("m", "bad", "1:10", 1e-6, 6.0)],
                               "MODEL string, OUTCOME string, POS string, P double, NEGLOG10P double")
    got = rows(post.manhattan_points(df).select("OUTCOME", "POS", "GENOME_X"))
    assert got == [("o", "1:10", 10), ("o", "1:20", 20), ("o", "2:10", 30), ("o", "2:20", 40)]


def test_small_post_operators(spark):
    df = spark.createDataFrame([("1:9", 0.0), ("META5", 0.5)], "POS string, P double")
    assert {r.POS: r.NEGLOG10P for r in post.with_neglog10p(df).collect()} == {"1:9": math.inf, "META5": pytest.approx(-math.log10(0.5))}
    v, s = post.split_scores(df)
    assert [r.POS for r in v.collect()] == ["1:9"] and [r.POS for r in s.collect()] == ["META5"]
    order = spark.createDataFrame([("10:1",), ("2:30",), ("2:4",)], "POS string")
    assert [r.POS for r in post.genomic_order(order).collect()] == ["2:4", "2:30", "10:1"]
    assert [r.POS for r in post.byte_order(order).collect()] == ["10:1", "2:30", "2:4"]
    lines = spark.createDataFrame([("1:5 rs2 X",), ("1:5 rs1 Y",), ("2:5 rs9 Z",)], "value string")
    assert rows(genotype.by_position_first(lines)) == [("1:5", "1:5 rs1 Y"), ("2:5", "2:5 rs9 Z")]
    assert manifest.formula("lnmxs", "HY", ["AAO"]) == "HY ~ snp + AAO + snp:YEARfDIAG + (1 | IID)"


# ------------------------------------------------------------------ structure
def calls(spark, n=40, v=30, chrs=2, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.binomial(2, 0.4, size=(n, v))
    for j in range(1, v):
        if j % 3 == 1:
            copy = rng.random(n) < 0.85
            base[copy, j] = base[copy, j - 1]
    base[n - 1] = base[0]
    data = [
        ("D", i, f"{1 + j % chrs}:{1000 * (j + 1)}", 1 + j % chrs, 1000 * (j + 1), None if (i * 7 + j) % 23 == 0 and i not in (0, n - 1) else int(base[i, j]))
        for i in range(n) for j in range(v)
    ]
    return spark.createDataFrame(data, "DATASET string, IID long, POS string, CHR int, BP long, GT int"), base


def test_hardy_weinberg_against_brute_force(spark):
    from fractions import Fraction
    from math import factorial as f

    data = [(18, 68, 11), (10, 71, 15), (0, 0, 5), (3, 1, 0), (25, 50, 25)]
    df = spark.createDataFrame(data, "a long, b long, c long").select("a", "b", "c", N.hardy_weinberg_p("a", "b", "c").alias("p"))
    for a, h, b, got in rows(df):
        n, rare = a + h + b, h + 2 * min(a, b)
        w = {k: Fraction(2**k, f((rare - k) // 2) * f(k) * f((2 * n - rare - k) // 2)) for k in range(rare % 2, rare + 1, 2)}
        assert got == pytest.approx(float(sum(x for x in w.values() if x <= w[h]) / sum(w.values())), rel=1e-9)


def test_hardy_weinberg_tails_of_large_counts():
    """The recurrence against log factorials, for rows of very different size at once."""
    rng = np.random.default_rng(3)
    n0, n1, n2 = rng.integers(0, 4000, (3, 300)) // rng.choice([1, 10, 1000], (3, 300))
    got = N.hardy_weinberg_tail(n0, n1, n2)
    log_f = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 30_000)))])
    for a, h, b, p in zip(n0, n1, n2, got):
        n, rare = a + h + b, h + 2 * min(a, b)
        k = np.arange(rare % 2, rare + 1, 2)
        w = k * np.log(2.0) - log_f[(rare - k) // 2] - log_f[k] - log_f[(2 * n - rare - k) // 2]
        w = np.exp(w - w.max())
        assert p == pytest.approx(min(w[w <= w[k == h] * (1 + 1e-9)].sum() / w.sum(), 1.0), rel=1e-7, abs=1e-290)


@pytest.mark.parametrize("block, slices", [(7, 65_536), (1024, 65_536), (16, 11), (1024, 7)])
def test_duplicates_are_found_for_any_block_and_slice(spark, block, slices):
    geno, _ = calls(spark)
    got = structure.related_pairs(geno, 0.95, block, slices)
    assert [(r.IID1, r.IID2, r.IBS0, r.IBS1) for r in got.collect()] == [(0, 39, 0, 0)]


def test_sharing_counts_equal_plain_counts(spark):
    geno, _ = calls(spark, 25, 70)
    table = {}
    for r in geno.where("GT IS NOT NULL").collect():
        table.setdefault(r.IID, {})[r.POS] = r.GT
    got = {(r.IID1, r.IID2): (r.IBS0, r.IBS1, r.IBS2) for r in structure.related_pairs(geno, -9.0, 10, 32).collect()}
    assert len(got) == 25 * 24 // 2
    for (i, j), counts in got.items():
        apart = [abs(table[i][p] - table[j][p]) for p in set(table[i]) & set(table[j])]
        assert counts == (apart.count(2), apart.count(1), apart.count(0))


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


@pytest.mark.parametrize("slices", [8192, 7])
def test_pairs_of_sample_arrays_equal_those_of_calls(spark, slices):
    """With a missing call, a null id, a sample without calls, one that comes twice and arrays of different length."""
    rng = np.random.default_rng(8)
    rows = [(i, [None if rng.random() < 0.1 else int(rng.integers(0, 3)) for _ in range(20 if i % 5 else 17)]) for i in range(40)]
    rows += [(40, rows[3][1]), (41, None), (42, []), (None, [1] * 20), (4, rows[4][1])]
    geno = spark.createDataFrame(rows, "IID long, CALLS array<tinyint>")
    long = geno.select("IID", F.posexplode("CALLS").alias("POS", "GT"))
    got, want = (sorted(map(tuple, structure.related_pairs(g, -9.0, 16, slices).collect())) for g in (geno, long))
    assert len(got) == 41 * 40 // 2 and [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])
    assert [r[:2] for r in map(tuple, structure.related_pairs(geno, 0.95, None, slices).collect())] == [(3, 40)]


def test_counts_of_pairs_are_not_written(spark):
    """300 pairs of blocks: their counts would take 15 MB before compression, their packed calls less than one."""
    rng = np.random.default_rng(9)
    rows = [(i, f"1:{p}", int(x)) for i, row in enumerate(rng.integers(0, 3, (1500, 8))) for p, x in enumerate(row)]
    geno = spark.createDataFrame(rows, "IID long, POS string, GT int").cache()
    geno.count()
    before = set(shuffle_files(spark))
    structure.related_pairs(geno, 2.0, 64).count()
    assert sum(size for name, size in shuffle_files(spark).items() if name not in before) < 2_500_000
    geno.unpersist()


def greedy_removals(band, count, window, step, vif):
    """Sliding-window pruning with a fresh inverse for every removal."""
    gone = set()
    for first in range(0, count, step):
        while True:
            here = [i for i in range(first, min(first + window, count)) if i not in gone]
            r = np.array([[1.0 if i == j else band.get((min(i, j), max(i, j)), 0.0) for j in here] for i in here])
            inflation = np.diag(np.linalg.inv(r)) if len(here) > 1 else np.zeros(1)
            if inflation.max() <= vif:
                break
            gone.add(here[int(inflation.argmax())])
    return gone


def test_downdates_equal_fresh_inverses():
    """Two hundred variants in windows of fifty, as the standard settings have them."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 200))
    for j in range(1, 200):
        x[:, j] = 0.75 * x[:, j - 1] + 0.66 * x[:, j] if j % 4 else x[:, j]
    r = np.corrcoef(x.T)
    band = np.zeros((250, 50))
    for i in range(200):
        for k in range(1, min(50, 200 - i)):
            band[i, k] = r[i, i + k]
    want = greedy_removals({(i, i + k): band[i, k] for i in range(200) for k in range(1, min(50, 200 - i))}, 200, 50, 5, 2.0)
    assert structure._prune_segment(0, 200, band, set(), 199, 50, 5, 2.0) == want and 20 < len(want) < 180


def test_ld_pruning_equals_the_sequential_run(spark, monkeypatch):
    geno, _ = calls(spark, chrs=1)
    monkeypatch.setattr(structure, "LD_BLOCK", 16)
    pairs, placed = structure.ld_pairs(geno, 6)
    pos = {(r.CHR, r.POS): r.I for r in placed.collect()}
    table = {}
    for r in geno.where("GT IS NOT NULL").collect():
        table.setdefault((r.CHR, pos[(r.CHR, r.POS)]), {})[r.IID] = r.GT
    band = {}
    for r in pairs.collect():
        a, b = table[(r.CHR, r.I)], table[(r.CHR, r.J)]
        both = sorted(set(a) & set(b))
        assert r.N == len(both)
        assert r.R == pytest.approx(np.corrcoef([a[i] for i in both], [b[i] for i in both])[0, 1])
        band[(r.CHR, r.I, r.J)] = r.R
    assert len(band) == sum(min(5, 29 - i) for i in range(30))
    gone = greedy_removals({(i, j): r for (_, i, j), r in band.items()}, 30, 6, 2, 1.5)
    kept = {(1, p) for (_, p), i in pos.items() if i not in gone}
    for segment in (2, 4, 1000):
        assert set(rows(structure.ld_prune(geno, 6, 2, 1.5, segment))) == kept
    assert 0 < len(kept) < 30


def test_principal_components_match_svd(spark):
    geno, _ = calls(spark)
    pc = structure.principal_components(geno, 3).toPandas().sort_values("IID")
    wide = geno.toPandas().pivot(index="IID", columns="POS", values="GT")
    freq = wide.mean() / 2
    z = ((wide - 2 * freq) / np.sqrt(2 * freq * (1 - freq))).fillna(0).to_numpy(float)
    u = np.linalg.svd(z, full_matrices=False)[0]
    for k in range(3):
        assert abs(u[:, k] @ pc[f"PC{k + 1}"].to_numpy()) == pytest.approx(1.0, abs=1e-7)
    # Several blocks and slices, the last of each part-filled, add up to the same.
    cut = structure.principal_components(geno, 3, block=7, slice_variants=5).toPandas().sort_values("IID")
    assert list(cut["IID"]) == list(pc["IID"])
    assert np.abs(cut[["PC1", "PC2", "PC3"]].to_numpy() - pc[["PC1", "PC2", "PC3"]].to_numpy()).max() < 1e-7


def test_principal_components_of_nothing_and_of_one_cohort_beside_a_constant_one(spark):
    schema = "DATASET string, IID long, POS string, GT int"
    assert structure.principal_components(spark.createDataFrame([], schema), 2).count() == 0
    rows_ = [("D0", i, f"1:{j}", (i * j + i // 2) % 3) for i in range(12) for j in range(1, 9)]
    flat = [("D1", i, f"1:{j}", 0) for i in range(12) for j in range(1, 9)] + [("D0", 99, "1:1", None)]
    got = structure.principal_components(spark.createDataFrame(rows_ + flat, schema), 2).toPandas()
    assert set(got["DATASET"]) == {"D0"} and len(got) == 12
    assert np.allclose((got[["PC1", "PC2"]] ** 2).sum(), 1.0) and abs(got["PC1"] @ got["PC2"]) < 1e-7


def test_array_layout_round_trip_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(genotype, "BLOCK_SAMPLES", 7)
    geno, _ = calls(spark)
    long = geno.select("DATASET", "IID", "POS", F.lit("A").alias("A1"), F.lit("G").alias("A2"), F.col("GT").cast("double").alias("DOSAGE"))
    index = genotype.sample_index(long)
    arrays = genotype.to_array(long, index)
    assert arrays.agg(F.max(F.size("DOSAGE"))).first()[0] == 7 and arrays.select("SB").distinct().count() == 6
    back = genotype.to_long(arrays, index)
    assert rows(back.select("IID", "POS", F.coalesce("DOSAGE", F.lit(-1.0)))) == rows(long.select("IID", "POS", F.coalesce("DOSAGE", F.lit(-1.0))))


def test_wide_and_long_tables(spark):
    wide = spark.createDataFrame([("s1", "DOSE", 0.5, 1.5)], ["IID", "DOSE", "1:5_G_A", "GBA"])
    long = genotype.wide_to_long(wide)
    assert rows(long) == [("s1", "1:5_G_A", 0.5), ("s1", "GBA", 1.5)]
    table = long.select(F.lit("D").alias("DATASET"), "IID", F.col("VARIANT").alias("POS"), "DOSAGE")
    assert rows(genotype.long_to_wide(table, ["GBA", "1:5_G_A"])) == [("D", "s1", 0.5, 1.5)]


def test_scores(spark):
    geno = spark.createDataFrame([("D", "s1", "1:155205634", "C", "T", 1), ("D", "s1", "1:155206167", "A", "T", 0), ("D", "s2", "1:155205634", "C", "T", 0)],
                                 "DATASET string, IID string, POS string, A1 string, A2 string, GT int")
    w = scores.carrier_weights(spark)
    assert rows(scores.carrier_score(geno, w)) == [("D", "s1", 201.0, 1), ("D", "s2", 0.0, 0)]
    assert rows(scores.unscored_variants(w, geno).select("POS")) == [("1:155206037",)]
    poly = {r.IID: r.SCORE for r in scores.polygenic_score(geno, w, standardise=False).collect()}
    assert poly == {"s1": (1.0 + 200.0) / 4, "s2": 0.0}
    assert scores.as_variants(scores.carrier_score(geno, w), "GBA", "CARRIER").first().POS == "GBA"


# ------------------------------------------------------------------ whole run
def test_lifecycle_from_visits_to_tiers(spark):
    from cohortscan.models.api import scan
    from cohortscan.plans.lifecycle import combine_results, grade, prepare_phenotypes

    rng = np.random.default_rng(2)
    visit, geno, ident = [], [], []
    for d in ("P", "Q"):
        for i in range(60):
            iid, s = f"{i}_{i}", rng.integers(0, 3, 3)
            ident.append((d, iid, str(i), d))
            for k, snp in enumerate(s):
                geno.append((d, iid, f"1:{k + 1}", "A", "G", float(snp)))
            for t in range(4):
                visit.append((d, str(i), 180.0 * t, int(rng.random() < 0.2 + 0.2 * t), float(s[0] * 0.8 + t * 0.3 + rng.normal()), 60.0 + i, 1.0 + i % 5, 1.0 + i % 5 + t / 2))
    ids_ = spark.createDataFrame(ident, "DATASET string, IID string, ID string, COHORT string")
    ph = spark.createDataFrame(visit, "STUDY_NAME string, ID string, TSTART double, CONST int, HY double, AAO double, BLDfDIAG double, YEARfDIAG double").withColumn("FEMALE", F.lit(0))
    comps = spark.createDataFrame([(d, f"{i}_{i}", float(rng.normal())) for d in ("P", "Q") for i in range(60)], "DATASET string, IID string, PC1 double")
    ready = prepare_phenotypes(ids_, ph, comps, ["CONST"], ["HY"], ["FEMALE", "AAO", "BLDfDIAG"])
    plan = {(r.TYPE, r.DATASET) for r in ready.manifest.collect()}
    assert {("lnmxi", "P"), ("coxhm", "P"), ("lnmxs", "Q"), ("lncns", "Q")} <= plan
    g = spark.createDataFrame(geno, "DATASET string, IID string, POS string, A1 string, A2 string, DOSAGE double")
    mixed_ = scan("lnmxi", g, ready.longitudinal, ["AAO", "YEARfDIAG"], ready.manifest)
    cox_ = scan("coxhm", g, ready.survival, ["AAO", "BLDfDIAG"], ready.manifest)
    results = combine_results(mixed_.unionByName(cox_))
    cells = {(r.POS, r.MODEL): r for r in grade(results).collect()}
    assert set(m for _, m in cells) == {"lnmxs_intcp", "coxhm"} and cells[("1:1", "lnmxs_intcp")].TIER == 5


def test_tails_and_quantiles_are_exact(spark):
    import math

    from cohortscan.functions import columns as C

    x = [0.0, 1e-9, 0.3, 0.46875, 0.5, 1.0, 2.0, 4.0, 4.001, 10.0, 26.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(C.log_erfc(F.col("x"))).collect()
    assert all(math.exp(r[0]) == pytest.approx(math.erfc(v), rel=1e-12) for v, r in zip(x, got))
    far = spark.createDataFrame([(1e4,)], "z double").select(C.neglog10_p(F.col("z"))).first()[0]
    assert math.isfinite(far) and far > 2e7
    p = [0.999, 0.5, 0.05, 1e-3, 1e-8]
    back = spark.createDataFrame([(v,) for v in p], "p double").select(C.chi2_1_upper_quantile(F.col("p"))).collect()
    assert all(math.erfc(math.sqrt(r[0] / 2)) == pytest.approx(v, rel=1e-9) for v, r in zip(p, back))


def test_stored_zero_p_follows_from_the_statistic(spark):
    df = spark.createDataFrame([(0.0, 4.0, 0.1), (0.01, 1.0, 1.0), (None, 1.0, 1.0)], "P double, Effect double, StdErr double")
    got = [r.NEGLOG10P for r in post.with_neglog10p(df).collect()]
    assert 300 < got[0] < 400 and got[1] == pytest.approx(2.0) and got[2] is None
