"""Id matching, phenotype, survival and genotype preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscan.functions.columns import chromosome, rounded
from cohortscan.operators import contrast as C
from cohortscan.operators import genotype as G
from cohortscan.operators import ids as I
from cohortscan.operators import manifest as M
from cohortscan.operators import pheno as P
from cohortscan.operators import scores as S
from cohortscan.operators import survival as V
from cohortscan.plans.queries_post import round_columns
from cohortscan.plans.registry import query
from cohortscan.plans.views import Tables, rnd, sql_with

_NAMES = ["OSLO", "HBS", "DIGPD_neuroX", "DIGPD_chip", "PARKFIT", "PDBP"]


# ------------------------------------------------------------------ id tables
def _id_tables(t: Tables):
    key = F.col("c_custkey")
    customer = t.read("customer")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (key % 6 + 1).cast("int"))
    plain = F.concat(F.lit("id"), key.cast("string"))
    samples = customer.select(
        name.alias("DATASET"),
        F.when(name == "HBS", F.concat(F.lit("HBS"), key.cast("string")))
        .otherwise(F.concat_ws("_", plain, plain)).alias("IID"),
    )
    linked = customer.where(key % 6 <= 1).select(
        plain.alias("FID"), plain.alias("IID"), F.concat(F.lit("k"), key.cast("string")).alias("Clincal_ID")
    )
    hbs, clinical = F.concat(F.lit("HBS"), key.cast("string")), F.concat(F.lit("c"), key.cast("string"))
    pairs = customer.where(key % 3 == 1).select(
        F.when(key % 2 == 0, hbs).otherwise(clinical).alias("IID1"),
        F.when(key % 2 == 0, clinical).otherwise(hbs).alias("IID2"),
    )
    study = F.when(name.startswith("DIGPD"), "DIGPD").otherwise(name)
    clinical_id = (
        F.when(name == "OSLO", F.concat(F.lit("k"), key.cast("string"))).when(name == "HBS", clinical)
        .when(name == "PARKFIT", F.upper(plain)).otherwise(plain)
    )
    pheno = customer.where(key % 7 != 0).select(
        study.alias("STUDY_NAME"), clinical_id.alias("ID"), F.lit(0.0).alias("TSTART"),
        F.col("c_acctbal").alias("HY"),
    )
    return samples, linked, pairs, pheno


_ID_CTES = {
    "base": """SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'OSLO' WHEN 1 THEN 'HBS' WHEN 2 THEN 'DIGPD_neuroX'
 WHEN 3 THEN 'DIGPD_chip' WHEN 4 THEN 'PARKFIT' ELSE 'PDBP' END AS DATASET, 'id' || c_custkey AS p, c_acctbal FROM customer""",
    "ids": """SELECT DATASET, CASE WHEN DATASET = 'HBS' THEN 'HBS' || k ELSE p || '_' || p END AS IID,
 CASE DATASET WHEN 'OSLO' THEN 'k' || k WHEN 'HBS' THEN 'c' || k WHEN 'PARKFIT' THEN upper(p) ELSE p END AS ID,
 CASE WHEN DATASET LIKE 'DIGPD%' THEN 'DIGPD' ELSE DATASET END AS COHORT FROM base
 WHERE DATASET <> 'HBS' OR k % 3 = 1""",
    "pheno": """SELECT CASE WHEN DATASET LIKE 'DIGPD%' THEN 'DIGPD' ELSE DATASET END AS COHORT,
 CASE DATASET WHEN 'OSLO' THEN 'k' || k WHEN 'HBS' THEN 'c' || k WHEN 'PARKFIT' THEN upper(p) ELSE p END AS ID,
 0.0::DOUBLE AS TSTART, c_acctbal AS HY FROM base WHERE k % 7 <> 0""",
}


@query("id_mapping_union", sql_with("", "SELECT * FROM ids", **_ID_CTES).lstrip())
def id_mapping_union(spark, path):
    samples, linked, pairs, _ = _id_tables(Tables(spark, path))
    return I.map_ids(samples, linked, pairs)


@query("unmatched_ids", sql_with("", "SELECT * FROM ids WHERE (COHORT, ID) NOT IN (SELECT (COHORT, ID) FROM pheno)", **_ID_CTES))
def unmatched_ids(spark, path):
    samples, linked, pairs, pheno = _id_tables(Tables(spark, path))
    return I.audit_ids(I.map_ids(samples, linked, pairs), pheno)


@query("pheno_join_ids", sql_with("", f"""SELECT i.DATASET, i.IID, i.ID, i.COHORT, p.TSTART, {rnd('p.HY')} AS HY
 FROM ids i JOIN pheno p ON i.COHORT = p.COHORT AND i.ID = p.ID""", **_ID_CTES))
def pheno_join_ids(spark, path):
    samples, linked, pairs, pheno = _id_tables(Tables(spark, path))
    return round_columns(I.join_phenotypes(I.map_ids(samples, linked, pairs), pheno), ["HY"])


@query("pheno_left_join_ids", sql_with("", """SELECT i.DATASET, CAST(count(*) AS BIGINT) AS N_IDS, CAST(count(p.HY) AS BIGINT) AS N_MATCHED
 FROM ids i LEFT JOIN pheno p ON i.COHORT = p.COHORT AND i.ID = p.ID GROUP BY 1""", **_ID_CTES))
def pheno_left_join_ids(spark, path):
    samples, linked, pairs, pheno = _id_tables(Tables(spark, path))
    joined = I.join_phenotypes(I.map_ids(samples, linked, pairs), pheno, "left")
    return joined.groupBy("DATASET").agg(F.count(F.lit(1)).alias("N_IDS"), F.count("HY").alias("N_MATCHED"))


@query("eigenvector_ids", sql_with("", """SELECT DATASET, CASE WHEN DATASET IN ('HBS','OSLO','PDBP','PPMI') THEN p ELSE p || '_' || p END AS FID,
 CASE WHEN DATASET IN ('HBS','OSLO','PDBP','PPMI') THEN p ELSE p || '_' || p END AS IID FROM base""", base=_ID_CTES["base"]))
def eigenvector_ids(spark, path):
    key = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (key % 6 + 1).cast("int"))
    plain = F.concat(F.lit("id"), key.cast("string"))
    raw = Tables(spark, path).read("customer").select(name.alias("DATASET"), plain.alias("FID"), plain.alias("IID"))
    return I.eigenvector_ids(raw)


# ------------------------------------------------------------------ variants
@query("variant_qc_filter", sql_with("info", """SELECT DATASET, SNP, CAST(split_part(SNP, ':', 1) AS INTEGER) AS CHR,
 CAST(split_part(SNP, ':', 2) AS BIGINT) AS BP, SNP || '-' || split_part(SNP, ':', 2) AS RANGE, MAF, RSQ FROM info
 WHERE MAF >= 0.05 AND RSQ >= 0.8"""))
def variant_qc_filter(spark, path):
    kept = G.qc_variants(Tables(spark, path).info(), *G.QC_PRESETS["strict"])
    return kept.select("DATASET", "SNP", "CHR", "BP", "RANGE", "MAF", "RSQ")


@query("target_variants", sql_with("info annot", """SELECT DATASET, SNP, RSQ FROM info WHERE RSQ > 0.3 AND SNP IN
 (SELECT POS FROM annot WHERE FXNCLASS = 'ECONOMY')"""))
def target_variants(spark, path):
    t = Tables(spark, path)
    listed = t.annot().where(F.col("FXNCLASS") == "ECONOMY").select(F.col("POS").alias("SNP"))
    return G.keep_positions(G.target_variants(t.info()), listed, ["SNP"]).select("DATASET", "SNP", "RSQ")


def _placed(t: Tables):
    """Variants spread over whole chromosomes so that regions bite."""
    key = F.col("p_partkey")
    return t.read("part").select(
        (F.lit(1) + key % 22).cast("int").alias("CHR"), (key * 30_000 % 150_000_000).alias("BP"),
        F.concat(F.lit("D"), (F.col("p_size") % 3).cast("string")).alias("DATASET"),
        F.concat(F.lit("v"), key.cast("string")).alias("SNP"),
    )


_PLACED = """SELECT CAST(1 + p_partkey % 22 AS INTEGER) AS CHR, p_partkey * 30000 % 150000000 AS BP,
 'D' || CAST(p_size % 3 AS VARCHAR) AS DATASET, 'v' || p_partkey AS SNP FROM part"""
_REGION_TEST = """(CHR = 5 AND BP BETWEEN 44000000 AND 51500000 OR CHR = 6 AND BP BETWEEN 25000000 AND 33500000
 OR CHR = 8 AND BP BETWEEN 8000000 AND 12000000 OR CHR = 11 AND BP BETWEEN 45000000 AND 57000000)"""


@query("region_exclude", sql_with("", f"SELECT * FROM placed WHERE NOT {_REGION_TEST}", placed=_PLACED))
def region_exclude(spark, path):
    return G.exclude_regions(_placed(Tables(spark, path)), G.excluded_regions(spark))


@query("region_keep", sql_with("", f"SELECT * FROM placed WHERE {_REGION_TEST}", placed=_PLACED))
def region_keep(spark, path):
    return G.keep_regions(_placed(Tables(spark, path)), G.excluded_regions(spark))


@query("range_include", sql_with("info", """SELECT * FROM placed WHERE SNP IN (SELECT 'v' || split_part(SNP, ':', 2) FROM info
 WHERE MAF >= 0.05 AND RSQ >= 0.8)""", placed=_PLACED))
def range_include(spark, path):
    t = Tables(spark, path)
    good = G.qc_variants(t.info(), *G.QC_PRESETS["strict"])
    listed = good.select("CHR", (F.col("BP") * 30_000 % 150_000_000).alias("BP"), F.concat(F.lit("v"), F.col("BP").cast("string")).alias("SNP"))
    return G.keep_positions(_placed(t), listed, ["CHR", "BP", "SNP"]).select("CHR", "BP", "DATASET", "SNP")


@query("variant_blocks", sql_with("", """SELECT DATASET, CHR, BP, SNP, CAST(floor((row_number() OVER
 (PARTITION BY DATASET, CHR ORDER BY BP, SNP) - 1) / 10) AS BIGINT) AS BLOCK FROM placed""", placed=_PLACED))
def variant_blocks(spark, path):
    return G.variant_blocks(_placed(Tables(spark, path)), 10).select("DATASET", "CHR", "BP", "SNP", "BLOCK")


@query("variant_counts", sql_with("", "SELECT DATASET, CHR, CAST(count(*) AS BIGINT) AS N_VARIANTS FROM placed GROUP BY 1, 2", placed=_PLACED))
def variant_counts(spark, path):
    return G.variant_counts(_placed(Tables(spark, path)))


# ------------------------------------------------------------------ genotypes
@query("geno_long", sql_with("geno", f"SELECT IID, POS, CHR, BP, GT, {rnd('DOSAGE')} AS DOSAGE FROM geno"))
def geno_long(spark, path):
    return Tables(spark, path).geno().select("IID", "POS", "CHR", "BP", "GT", rounded(F.col("DOSAGE")).alias("DOSAGE"))


@query("geno_arrays", sql_with("cgeno", f"SELECT DATASET, IID, POS, A1, A2, {rnd('CAST(CAST(DOSAGE AS FLOAT) AS DOUBLE)')} AS DOSAGE FROM cgeno"))
def geno_arrays(spark, path):
    """Long rows packed into sample-block arrays and unpacked again."""
    geno = Tables(spark, path).cohort_geno()
    index = G.sample_index(geno)
    return round_columns(G.to_long(G.to_array(geno, index), index), ["DOSAGE"]).select(
        "DATASET", "IID", "POS", "A1", "A2", "DOSAGE"
    )


@query("geno_impute_mean", sql_with("cgeno", f"""SELECT g.DATASET, IID, g.POS, {rnd('coalesce(DOSAGE, m)')} AS DOSAGE FROM cgeno g JOIN
 (SELECT DATASET, POS, avg(DOSAGE) AS m FROM cgeno GROUP BY 1, 2) a ON g.DATASET = a.DATASET AND g.POS = a.POS"""))
def geno_impute_mean(spark, path):
    filled = G.impute_mean(Tables(spark, path).cohort_geno())
    return round_columns(filled.select("DATASET", "IID", "POS", "DOSAGE"), ["DOSAGE"])


_STATS_SQL = """SELECT DATASET, POS, CAST(sum(CASE WHEN GT = 0 THEN 1 ELSE 0 END) AS BIGINT) AS N0, CAST(sum(CASE WHEN GT = 1 THEN 1 ELSE 0 END) AS BIGINT) AS N1,
 CAST(sum(CASE WHEN GT = 2 THEN 1 ELSE 0 END) AS BIGINT) AS N2, CAST(sum(CASE WHEN GT IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS N_MISSING,
 CAST(count(*) AS BIGINT) AS N FROM (SELECT 'D' || CAST(IID % 5 AS VARCHAR) AS DATASET, POS, GT FROM geno) GROUP BY 1, 2"""


@query("variant_maf_missing", sql_with("geno", f"""SELECT DATASET, POS, N0, N1, N2, N_MISSING, N, {rnd('f')} AS ALT_FRQ, {rnd('least(f, 1 - f)')} AS MAF,
 {rnd('N_MISSING / N')} AS MISSING_RATE FROM (SELECT *, (N1 + 2 * N2) / (2.0 * (N0 + N1 + N2))::DOUBLE AS f FROM st)""", st=_STATS_SQL))
def variant_maf_missing(spark, path):
    stats = G.variant_stats(G.hard_calls(Tables(spark, path).cohort_geno()), ["DATASET", "POS"])
    return round_columns(stats, ["ALT_FRQ", "MAF", "MISSING_RATE"])


@query("geno_merge", sql_with("geno", """SELECT m.IID, m.CHR, m.BP, m.A1, m.A2, m.GT FROM m WHERE (CHR, BP) NOT IN
 (SELECT (CHR, BP) FROM (SELECT CHR, BP, A1 AS a FROM m UNION SELECT CHR, BP, A2 FROM m) GROUP BY CHR, BP HAVING count(*) > 2)""",
    m="""SELECT IID, CHR, BP, 'A' AS A1, 'G' AS A2, GT FROM geno WHERE IID % 2 = 0 UNION ALL
 SELECT IID, CHR, BP, CASE WHEN CHR % 5 = 0 THEN 'T' ELSE 'A' END, 'G', GT FROM geno WHERE IID % 2 = 1"""))
def geno_merge(spark, path):
    geno = Tables(spark, path).geno()
    first = geno.where(F.col("IID") % 2 == 0).select("IID", "CHR", "BP", F.lit("A").alias("A1"), F.lit("G").alias("A2"), "GT")
    second = geno.where(F.col("IID") % 2 == 1).select(
        "IID", "CHR", "BP", F.when(F.col("CHR") % 5 == 0, "T").otherwise("A").alias("A1"), F.lit("G").alias("A2"), "GT"
    )
    return G.merge_sets(first, second).select("IID", "CHR", "BP", "A1", "A2", "GT")


def _weights(t: Tables):
    geno = t.geno().select("POS", "J").distinct()
    return geno.where(F.col("J") % 3 == 0).select(
        "POS", F.when(F.col("J") % 2 == 0, "A").otherwise("T").alias("EFFECT_ALLELE"),
        ((F.col("J") % 7 - 3) / F.lit(10.0)).alias("WEIGHT"),
    )


_SCORE_CTES = {
    "wts": """SELECT DISTINCT POS, CASE WHEN J % 2 = 0 THEN 'A' ELSE 'T' END AS EA, (J % 7 - 3) / 10.0::DOUBLE AS W FROM geno WHERE J % 3 = 0""",
    "cp": """SELECT 'D' || CAST(IID % 5 AS VARCHAR) AS DATASET, IID, CASE WHEN EA = 'A' THEN GT ELSE 2 - GT END AS c, W
 FROM geno g JOIN wts w ON g.POS = w.POS WHERE GT IS NOT NULL""",
}


@query("polygenic_score", sql_with("geno", f"""SELECT DATASET, IID, {rnd('(s - avg(s) OVER (PARTITION BY DATASET)) / stddev_samp(s) OVER (PARTITION BY DATASET)', 8)} AS SCORE
 FROM (SELECT DATASET, IID, sum(c * W) / (2.0 * count(*)) AS s FROM cp GROUP BY 1, 2)""", **_SCORE_CTES))
def polygenic_score(spark, path):
    t = Tables(spark, path)
    score = S.polygenic_score(G.hard_calls(t.cohort_geno()), _weights(t))
    return round_columns(score.select("DATASET", "IID", "SCORE"), ["SCORE"], 8)


@query("carrier_score", sql_with("geno", """SELECT 'D' || CAST(IID % 5 AS VARCHAR) AS DATASET, IID, CAST(sum(GT * CASE J WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END) AS DOUBLE) AS CODED_SUM,
 CAST(sum(GT) > 0 AS INTEGER) AS CARRIER FROM geno WHERE J IN (0, 1, 2) AND GT IS NOT NULL GROUP BY 1, 2"""))
def carrier_score(spark, path):
    t = Tables(spark, path)
    three = spark.createDataFrame([("1:1000", "A", 1.0), ("2:2000", "C", 10.0), ("3:3000", "A", 100.0)],
                                  "POS string, EFFECT_ALLELE string, WEIGHT double")
    return S.carrier_score(G.hard_calls(t.cohort_geno()), three)


@query("unscored_variants", sql_with("geno annot", "SELECT POS, ID FROM annot WHERE POS NOT IN (SELECT POS FROM geno)"))
def unscored_variants(spark, path):
    t = Tables(spark, path)
    return S.unscored_variants(t.annot().select("POS", "ID"), t.geno())


_TARGET_PARTS = """SELECT 'D' || CAST(IID % 5 AS VARCHAR) AS DATASET, IID, POS, DOSAGE, CHR AS SOURCE FROM geno WHERE DOSAGE IS NOT NULL
 UNION ALL SELECT 'D' || CAST(IID % 5 AS VARCHAR), IID, 'MEAN', avg(DOSAGE), 23 FROM geno GROUP BY IID HAVING avg(DOSAGE) > 0.95
 UNION ALL SELECT 'D' || CAST(IID % 5 AS VARCHAR), IID, 'CALLS', sum(GT)::DOUBLE, 24 FROM geno WHERE CHR = 1 GROUP BY IID"""


@query("target_table", sql_with("geno", f"""SELECT DATASET, IID, POS, {rnd('DOSAGE')} AS DOSAGE FROM tp WHERE IID IN
 (SELECT IID FROM tp GROUP BY IID HAVING count(DISTINCT SOURCE) = 24)""", tp=_TARGET_PARTS))
def target_table(spark, path):
    """All 22 chromosomes and two score tables, for the samples that have a row in each."""
    geno = G.hard_calls(Tables(spark, path).cohort_geno()).withColumn("SOURCE", chromosome(F.col("POS")))
    columns = ["DATASET", "IID", "POS", "DOSAGE", "SOURCE"]
    by_sample = geno.groupBy("DATASET", "IID").agg(
        F.avg("DOSAGE").alias("MEAN"), F.sum(F.when(F.col("SOURCE") == 1, F.col("GT"))).alias("CALLS"))
    mean = S.as_variants(by_sample.where(F.col("MEAN") > 0.95), "MEAN", "MEAN").withColumn("SOURCE", F.lit(23))
    calls = S.as_variants(by_sample, "CALLS", "CALLS").withColumn("SOURCE", F.lit(24))
    seen = geno.where(F.col("DOSAGE").isNotNull()).select(*columns)
    stacked = seen.unionByName(mean.select(*columns)).unionByName(calls.select(*columns))
    return round_columns(G.in_all_parts(stacked, 24).select("DATASET", "IID", "POS", "DOSAGE"), ["DOSAGE"])


# ------------------------------------------------------------------ phenotypes
@query("baseline_case_coding", sql_with("sv", """SELECT DATASET, IID, CAST(coalesce(CONST + 1, 0) AS INTEGER) AS CONST, CAST(coalesce(SLEEP + 1, 0) AS INTEGER) AS SLEEP,
 CAST(1 + FEMALE AS INTEGER) AS SEX, TSTART FROM (SELECT *, row_number() OVER (PARTITION BY DATASET, IID ORDER BY TSTART) AS rn FROM sv
 WHERE DATASET <> 'D4' AND TSTART = 0 OR DATASET = 'D4' AND TSTART > -365 AND TSTART < 365) WHERE rn = 1"""))
def baseline_case_coding(spark, path):
    visits = Tables(spark, path).subject_visits()
    rows = P.baseline(visits, I.CohortRules(without_baseline=("D4",)))
    coded = P.pedigree_columns(P.case_coding(rows, ["CONST", "SLEEP"]))
    return coded.select("DATASET", "IID", "CONST", "SLEEP", "SEX", "TSTART")


_COVS = ["FEMALE", "YEARSEDUC", "FAMILY_HISTORY", "AAO", "BLDfDIAG", "DOPA"]


@query("covariate_variance", sql_with("sv", " UNION ALL ".join(
    f"SELECT DATASET, '{c}' AS NAME, {rnd(f'var_samp({c})', 8)} AS VARIANCE FROM sv GROUP BY 1 HAVING var_samp({c}) > 0" for c in _COVS)))
def covariate_variance(spark, path):
    return round_columns(P.active_columns(Tables(spark, path).subject_visits(), _COVS), ["VARIANCE"], 8)


@query("outcome_case_counts", sql_with("sv", " UNION ALL ".join(
    f"SELECT DATASET, '{c}' AS OUTCOME, CAST(sum(CASE WHEN {c} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS N_CASES FROM sv GROUP BY 1"
    for c in ("CONST", "SLEEP"))))
def outcome_case_counts(spark, path):
    coded = P.case_coding(Tables(spark, path).subject_visits(), ["CONST", "SLEEP"])
    return P.outcome_case_counts(coded, ["CONST", "SLEEP"])


@query("longitudinal_outcomes", sql_with("sv", " UNION ALL ".join(
    f"""SELECT DATASET, '{c}' AS OUTCOME, CAST(max(n) AS BIGINT) AS MAX_FOLLOW_UP, CASE WHEN max(n) > 0 THEN 'longitudinal' ELSE 'single' END AS KIND
 FROM (SELECT DATASET, IID, count(CASE WHEN TSTART > 0 THEN {c} END) AS n FROM sv GROUP BY 1, 2) GROUP BY 1"""
    for c in ("HY", "DOPA"))))
def longitudinal_outcomes(spark, path):
    return P.longitudinal_outcomes(Tables(spark, path).subject_visits(), ["HY", "DOPA"])


@query("complete_cases", sql_with("sv", f"SELECT DATASET, IID, TSTART, CONST, {rnd('HY')} AS HY FROM sv WHERE CONST IS NOT NULL AND HY IS NOT NULL"))
def complete_cases(spark, path):
    kept = P.complete_cases(Tables(spark, path).subject_visits(), ["CONST", "HY"])
    return round_columns(kept.select("DATASET", "IID", "TSTART", "CONST", "HY"), ["HY"])


_Z = ["AAO", "YEARfDIAG", "DOPA"]


@query("zscore_covariates", sql_with("sv", "SELECT DATASET, IID, TSTART, " + ", ".join(
    f"{rnd(f'({c} - avg({c}) OVER (PARTITION BY DATASET)) / stddev_samp({c}) OVER (PARTITION BY DATASET)', 8)} AS {c}" for c in _Z
) + " FROM sv WHERE HY IS NOT NULL"))
def zscore_covariates(spark, path):
    rows = P.complete_cases(Tables(spark, path).subject_visits(), ["HY", *_Z])
    return round_columns(P.zscore(rows, _Z, ["DATASET"]).select("DATASET", "IID", "TSTART", *_Z), _Z, 8)


# ------------------------------------------------------------------ survival
SURVIVAL_CTES = {
    "so": """SELECT DATASET, IID, TSTART, BLDfDIAG, 'CONST' AS OUTCOME, CONST AS S FROM sv UNION ALL
 SELECT DATASET, IID, TSTART, BLDfDIAG, 'SLEEP', SLEEP FROM sv""",
    "fu": """SELECT DATASET, OUTCOME, IID, min(CASE WHEN S IS NOT NULL THEN TSTART END) AS B,
 coalesce(min(CASE WHEN S = 1 THEN TSTART END), max(CASE WHEN S IS NOT NULL THEN TSTART END)) AS E FROM so GROUP BY 1, 2, 3""",
    "win": """SELECT so.DATASET, so.OUTCOME, so.IID, TSTART, B, E, BLDfDIAG, coalesce(S, 0) AS S FROM so JOIN fu
 ON so.DATASET = fu.DATASET AND so.OUTCOME = fu.OUTCOME AND so.IID = fu.IID AND TSTART >= B AND TSTART <= E""",
    "iv": """SELECT DATASET, OUTCOME, IID, TSTART - B AS TSTART, nt - B AS TSTOP, ns AS EVENT, BLDfDIAG + B / 365.25::DOUBLE AS BLDfDIAG
 FROM (SELECT *, lead(TSTART) OVER w AS nt, lead(S) OVER w AS ns FROM win WINDOW w AS (PARTITION BY DATASET, OUTCOME, IID ORDER BY TSTART))
 WHERE nt IS NOT NULL""",
}


def survival_rows(t: Tables):
    return V.long_outcomes(t.subject_visits(), ["CONST", "SLEEP"], ["BLDfDIAG"])


@query("survival_window", sql_with("sv", "SELECT DATASET, OUTCOME, IID, TSTART, CAST(S AS INTEGER) AS STATUS, B AS \"BEGIN\", E AS \"END\" FROM win", **SURVIVAL_CTES))
def survival_window(spark, path):
    rows = V.windowed_visits(survival_rows(Tables(spark, path)))
    return rows.select("DATASET", "OUTCOME", "IID", "TSTART", "STATUS", "BEGIN", "END")


_KEPT = "SELECT iv.* FROM iv JOIN (SELECT DATASET, OUTCOME FROM iv GROUP BY 1, 2 HAVING sum(EVENT) > 19) k ON iv.DATASET = k.DATASET AND iv.OUTCOME = k.OUTCOME"


@query("survival_intervals", sql_with("sv", f"SELECT DATASET, OUTCOME, IID, TSTART, TSTOP, CAST(EVENT AS INTEGER) AS EVENT, {rnd('BLDfDIAG')} AS BLDfDIAG FROM kept",
                                      **SURVIVAL_CTES, kept=_KEPT))
def survival_intervals(spark, path):
    rows = V.build_survival(Tables(spark, path).subject_visits(), ["CONST", "SLEEP"], ["BLDfDIAG"])
    return round_columns(rows.select("DATASET", "OUTCOME", "IID", "TSTART", "TSTOP", "EVENT", "BLDfDIAG"), ["BLDfDIAG"])


@query("survival_event_counts", sql_with("sv", "SELECT DATASET, OUTCOME, CAST(count(*) AS BIGINT) AS N_OBS, CAST(sum(EVENT) AS BIGINT) AS N_EVENT FROM iv GROUP BY 1, 2", **SURVIVAL_CTES))
def survival_event_counts(spark, path):
    return V.event_counts(V.intervals(survival_rows(Tables(spark, path))))


@query("risk_set_sizes", sql_with("sv", """SELECT e.DATASET, e.OUTCOME, e.t AS TIME, CAST(e.d AS BIGINT) AS N_EVENT, CAST(count(*) AS BIGINT) AS N_RISK FROM
 (SELECT DATASET, OUTCOME, TSTOP AS t, sum(EVENT) AS d FROM iv GROUP BY 1, 2, 3 HAVING sum(EVENT) > 0) e JOIN iv
 ON e.DATASET = iv.DATASET AND e.OUTCOME = iv.OUTCOME AND iv.TSTART < e.t AND e.t <= iv.TSTOP GROUP BY 1, 2, 3, 4""", **SURVIVAL_CTES))
def risk_set_sizes(spark, path):
    return V.risk_sets(V.intervals(survival_rows(Tables(spark, path))))


# ------------------------------------------------------------------ contrasts
@query("within_subject_demean", sql_with("sv", "SELECT DATASET, IID, TSTART, N_VISITS, " + ", ".join(
    f"{rnd(f'CASE WHEN abs({c} - m_{c}) < 1e-10 THEN 0 ELSE {c} - m_{c} END')} AS {c}" for c in ("YEARfDIAG", "DOPA", "HY")
) + " FROM (SELECT *, CAST(count(*) OVER w AS BIGINT) AS N_VISITS, " + ", ".join(f"avg({c}) OVER w AS m_{c}" for c in ("YEARfDIAG", "DOPA", "HY"))
    + " FROM sv WHERE HY IS NOT NULL WINDOW w AS (PARTITION BY DATASET, IID)) WHERE N_VISITS > 1"))
def within_subject_demean(spark, path):
    rows = P.complete_cases(Tables(spark, path).subject_visits(), ["HY"])
    names = ["YEARfDIAG", "DOPA", "HY"]
    return round_columns(C.demean(rows, ["DATASET", "IID"], names).select("DATASET", "IID", "TSTART", "N_VISITS", *names), names)


@query("visit_ordinal", sql_with("sv", """SELECT DATASET, IID, TSTART, row_number() OVER (PARTITION BY DATASET, IID ORDER BY TSTART) AS VISIT FROM sv"""))
def visit_ordinal(spark, path):
    rows = Tables(spark, path).subject_visits()
    return C.visit_ordinal(rows, ["DATASET", "IID"]).select("DATASET", "IID", "TSTART", "VISIT")


# The sum of squares over a subject's contrast rows equals that of demeaned visits.
@query("contrast_rows", sql_with("sv", f"""SELECT DATASET, IID, CAST(count(*) - 1 AS BIGINT) AS N_ROWS, {rnd('var_pop(HY) * count(*)', 3)} AS SS_HY,
 {rnd('covar_pop(HY, YEARfDIAG) * count(*)', 3)} AS SP FROM sv WHERE HY IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"""))
def contrast_rows(spark, path):
    rows = P.complete_cases(Tables(spark, path).subject_visits(), ["HY"])
    out = C.contrast_rows(rows, ["DATASET", "IID"], "TSTART", ["HY", "YEARfDIAG"])
    return out.groupBy("DATASET", "IID").agg(
        F.count(F.lit(1)).alias("N_ROWS"), rounded(F.sum(F.col("HY") * F.col("HY")), 3).alias("SS_HY"),
        rounded(F.sum(F.col("HY") * F.col("YEARfDIAG")), 3).alias("SP"),
    )


# ------------------------------------------------------------------ manifest
@query("manifest_build", sql_with("manifest", """SELECT TYPE, OUTCOME, string_agg(DATASET, ',' ORDER BY DATASET) AS DATASETS FROM manifest GROUP BY 1, 2"""))
def manifest_build(spark, path):
    return M.dataset_lists(Tables(spark, path).manifest())


@query("manifest_text", sql_with("manifest", """SELECT TYPE, DATASET, OUTCOME, CAST(len(COV) AS INTEGER) AS N_COV FROM
 (SELECT *, CASE WHEN TYPE < '3' THEN ['AAO', 'FEMALE'] ELSE ['AAO'] END AS COV FROM manifest)"""))
def manifest_text(spark, path):
    """Manifest rows through their text form and back."""
    full = Tables(spark, path).manifest().withColumn(
        "COV", F.when(F.col("TYPE") < "3", F.array(F.lit("AAO"), F.lit("FEMALE"))).otherwise(F.array(F.lit("AAO")))
    )
    parsed = M.parse_manifest(M.to_text(M.build_manifest(full)))
    return parsed.select("TYPE", "DATASET", "OUTCOME", F.size("COV").alias("N_COV"))


@query("completeness_audit", sql_with("manifest", """SELECT *, 'planned' AS SIDE FROM (SELECT * FROM manifest EXCEPT SELECT * FROM done) UNION ALL
 SELECT *, 'finished' FROM (SELECT * FROM done EXCEPT SELECT * FROM manifest)""",
    done="""SELECT DISTINCT o_orderpriority AS TYPE, 'D' || CAST(o_custkey % 13 AS VARCHAR) AS DATASET,
 CASE WHEN o_custkey % 13 = 7 THEN 'X' ELSE o_orderstatus END AS OUTCOME FROM orders WHERE o_custkey % 13 <> 5"""))
def completeness_audit(spark, path):
    t = Tables(spark, path)
    done = t.manifest().where(F.col("DATASET") != "D5").withColumn(
        "OUTCOME", F.when(F.col("DATASET") == "D7", "X").otherwise(F.col("OUTCOME"))
    )
    return M.audit_jobs(t.manifest(), done)


@query("nan_to_null", sql_with("sv", f"""SELECT DATASET, CAST(count(*) AS BIGINT) AS N, CAST(count(HY) FILTER (WHERE HY <= 60) AS BIGINT) AS N_KNOWN,
 {rnd('avg(HY) FILTER (WHERE HY <= 60)', 6)} AS MEAN FROM sv GROUP BY 1"""))
def nan_to_null(spark, path):
    """A NaN in the source is a missing value: it counts in no average."""
    raw = Tables(spark, path).subject_visits().withColumn("HY", F.when(F.col("HY") > 60, F.lit(float("nan"))).otherwise(F.col("HY")))
    clean = P.nan_to_null(raw, ["HY"])
    return clean.groupBy("DATASET").agg(
        F.count(F.lit(1)).alias("N"), F.count("HY").alias("N_KNOWN"), rounded(F.avg("HY"), 6).alias("MEAN"))


@query("columns_by_prefix", sql_with("sv", f"SELECT DATASET, IID, TSTART, {rnd('YEARfDIAG', 6)} AS YEARfDIAG, DOPA FROM sv"))
def columns_by_prefix(spark, path):
    """The time-varying columns, picked by the beginnings of their names."""
    visits = Tables(spark, path).subject_visits()
    names = P.columns_like(visits, ["YEARfDIAG", "DOPA", "AGONIST"])
    return round_columns(visits.select("DATASET", "IID", "TSTART", *names), ["YEARfDIAG"], 6)


@query("time_covariates", sql_with("sv", f"""SELECT DATASET, IID, TSTART, {rnd('YEARfDIAG', 6)} AS YEARfDIAG, AAO FROM sv"""))
def time_covariates(spark, path):
    """Baseline years become years at the visit in models over visits."""
    visits = Tables(spark, path).subject_visits()
    names = P.time_covariate(["BLDfDIAG", "AAO"])
    return round_columns(visits.select("DATASET", "IID", "TSTART", *names), ["YEARfDIAG"], 6)
