"""Pooling and post-analysis queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.functions.columns import (
    CHI2_MEDIAN, neglog10_p, pack_counts, pack_key, rounded, two_sided_p, unpack_counts, unpack_key,
)
from cohortscan.operators import assoc as A
from cohortscan.operators import genotype as G
from cohortscan.operators import meta as M
from cohortscan.operators import post as P
from cohortscan.plans.registry import query
from cohortscan.plans.views import Tables, log_erfc_sql, nlp_sql, rnd, sql_with
from cohortscan.session import checkpointed

META_NUMBERS = [
    "Freq1", "FreqSE", "MinFreq", "MaxFreq", "Effect", "StdErr", "Z", "NEGLOG10P",
    "HetISq", "HetChiSq", "HetPVal",
]


# Tail probabilities and square roots of small differences carry fewer digits.
ROUGH = ("HetPVal", "FreqSE")


def round_columns(df: DataFrame, names: list[str], digits: int = 9) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n), 6 if n in ROUGH else digits) for n in names})


# ---------------------------------------------------------------- SQL pieces
def aligned_sql(source: str, by: str = "") -> str:
    return f"""SELECT {by} DATASET, POS, least(A1, A2) AS Allele1, greatest(A1, A2) AS Allele2,
 CASE WHEN A1 > A2 THEN -BETA ELSE BETA END AS b, 1.0 / (SE * SE) AS w,
 CASE WHEN A1 > A2 THEN 1 - ALT_FRQ ELSE ALT_FRQ END AS f FROM {source}"""


def chi2_sf_sql(x: str, df: str, most: int = 13) -> str:
    """Finite sums written out for every df up to ``most``."""
    cases = []
    for d in range(1, most + 1):
        if d % 2 == 0:
            first, terms, div = f"exp(-({x}) / 2)", [], 1.0
            for k in range(d // 2):
                div = div * (2 * k) if k else 1.0
                terms.append(f"power({x}, {k}) / {div!r}::DOUBLE")
            cases.append(f"WHEN {d} THEN {first} * ({' + '.join(terms)})")
        else:
            terms, div = ["0.0"], 1.0
            for k in range(d // 2):
                div = div * (2 * k + 1)
                terms.append(f"power({x}, {k}) / {div!r}::DOUBLE")
            cases.append(
                f"WHEN {d} THEN exp({log_erfc_sql(f'sqrt(({x}) / 2)')}) + "
                f"sqrt(2 * ({x}) / pi()) * exp(-({x}) / 2) * ({' + '.join(terms)})"
            )
    return f"(CASE {df} {' '.join(cases)} END)"


def meta_ctes(source: str, by: list[str]) -> dict[str, str]:
    g = "".join(f"{c}, " for c in by)
    on = " AND ".join(f"a.{c} = e.{c}" for c in by + ["POS", "Allele1", "Allele2"])
    md = " AND ".join(["1=1"] + [f"s.{c} = d.{c}" for c in by])
    ld = " AND ".join(f"a.{c} = s.{c}" for c in by + ["POS", "Allele1", "Allele2"])
    sg = "".join(f"s.{c}, " for c in by)
    eg = "".join(f"e.{c}, " for c in by)
    de = " AND ".join(f"d.{c} = e.{c}" for c in by + ["POS", "Allele1", "Allele2"])
    return {
        "al": aligned_sql(source, g),
        "pooled": f"""SELECT {g} POS, Allele1, Allele2, sum(w) AS sw, sum(w * b) / sum(w) AS Effect,
 sum(w * f) / sum(w) AS Freq1, min(f) AS MinFreq, max(f) AS MaxFreq, CAST(count(*) - 1 AS BIGINT) AS HetDf
 FROM al GROUP BY ALL""",
        "het": f"""SELECT {eg} e.POS, e.Allele1, e.Allele2, CASE WHEN e.HetDf = 0 THEN 0.0 ELSE sum(a.w * (a.b - e.Effect) * (a.b - e.Effect)) END AS Q,
 sqrt(sum(a.w * (a.f - e.Freq1) * (a.f - e.Freq1)) / sum(a.w)) AS FreqSE
 FROM pooled e JOIN al a ON {on} GROUP BY {eg} e.POS, e.Allele1, e.Allele2, e.HetDf""",
        "dirs": f"""SELECT {sg} s.POS, s.Allele1, s.Allele2, string_agg(CASE WHEN a.b > 0 THEN '+' WHEN a.b < 0 THEN '-'
 WHEN a.b = 0 THEN '0' ELSE '?' END, '' ORDER BY d.DATASET) AS Direction
 FROM pooled s JOIN (SELECT DISTINCT {g} DATASET FROM al) d ON {md}
 LEFT JOIN al a ON {ld} AND a.DATASET = d.DATASET GROUP BY ALL""",
        "meta": f"""SELECT {eg} e.POS, e.Allele1, e.Allele2, e.Freq1, h.FreqSE, e.MinFreq, e.MaxFreq, e.Effect,
 1 / sqrt(e.sw) AS StdErr, e.Effect * sqrt(e.sw) AS Z, {nlp_sql('(e.Effect * sqrt(e.sw))')} AS NEGLOG10P,
 d.Direction, CASE WHEN h.Q > e.HetDf THEN 100 * (h.Q - e.HetDf) / h.Q ELSE 0 END AS HetISq, h.Q AS HetChiSq,
 e.HetDf, least({chi2_sf_sql('h.Q', 'e.HetDf')}, 1.0) AS HetPVal
 FROM pooled e JOIN het h ON {on.replace('a.', 'h.')} JOIN dirs d ON {de}""",
    }


def meta_select(by: list[str], source: str = "meta") -> str:
    g = "".join(f"{c}, " for c in by)
    nums = ", ".join(f"{rnd(c, 6 if c in ROUGH else 9)} AS {c}" for c in META_NUMBERS)
    return f"SELECT {g} POS, Allele1, Allele2, Direction, HetDf, {nums} FROM {source}"


BY = ["MODEL", "OUTCOME"]
GC_CTES = {
    "lam": f"""SELECT DATASET, greatest(quantile_cont((BETA / SE) * (BETA / SE), 0.5) / {CHI2_MEDIAN}::DOUBLE, 1.0) AS l
 FROM assoc GROUP BY 1""",
    "gcassoc": "SELECT a.DATASET, POS, A1, A2, BETA, SE * sqrt(l) AS SE, ALT_FRQ FROM assoc a JOIN lam USING (DATASET)",
}
THRESHOLDS = """SELECT MODEL, OUTCOME, count(DISTINCT DATASET) AS n,
 CAST(count(DISTINCT DATASET) // 2 AS BIGINT) AS thr FROM assoc_tests GROUP BY 1, 2"""


def _meta_out(df: DataFrame, by: list[str]) -> DataFrame:
    return round_columns(
        df.select(*by, "POS", "Allele1", "Allele2", "Direction", "HetDf", *META_NUMBERS), META_NUMBERS
    )


def stored(results: DataFrame) -> DataFrame:
    """Cohort results are a stored table in a real run; write them out once."""
    return checkpointed(results)


def pooled_tests(t: Tables) -> DataFrame:
    return M.meta_fixed(stored(t.assoc_tests()))


# ------------------------------------------------------------------ pooling
@query("harmonise_alleles", sql_with("assoc", f"""SELECT DATASET, POS, {rnd('RSQ')} AS RSQ,
 CASE WHEN ALT_FRQ <= 0.5 THEN A1 ELSE A2 END AS MINOR_ALLELE, CASE WHEN ALT_FRQ <= 0.5 THEN A2 ELSE A1 END AS MAJOR_ALLELE,
 {rnd('CASE WHEN ALT_FRQ <= 0.5 THEN BETA ELSE -BETA END')} AS BETA, {rnd('SE')} AS SE,
 {rnd('CASE WHEN ALT_FRQ <= 0.5 THEN ALT_FRQ ELSE 1 - ALT_FRQ END')} AS MAF FROM assoc WHERE BETA < 5 AND BETA > -5"""))
def harmonise_alleles(spark, path):
    kept = A.keep_bounded_effects(Tables(spark, path).assoc(), F.lit("HY"))
    return round_columns(A.to_minor_allele(kept), ["RSQ", "BETA", "SE", "MAF"])


@query("assoc_join_info", sql_with("assoc info", f"""SELECT a.DATASET, a.POS, a.A1, a.A2, i.N_INFO, {rnd('a.BETA')} AS BETA,
 {rnd('a.SE')} AS SE, {rnd('i.MAF')} AS MAF FROM assoc a JOIN (SELECT SNP AS POS, A1, CAST(count(*) AS BIGINT) AS N_INFO,
 max(MAF) AS MAF FROM info GROUP BY 1, 2) i ON a.POS = i.POS AND a.A1 = i.A1 WHERE abs(a.BETA) < 5 AND a.RSQ > 0.3"""))
def assoc_join_info(spark, path):
    t = Tables(spark, path)
    info = t.info().groupBy(F.col("SNP").alias("POS"), F.col("A1").alias("INFO_A1")).agg(
        F.count(F.lit(1)).alias("N_INFO"), F.max("MAF").alias("MAF")
    )
    kept = A.keep_bounded_effects(t.assoc().where(F.col("RSQ") > 0.3), F.lit("HY"))
    joined = A.join_info(kept.select("DATASET", "POS", "A1", "A2", "BETA", "SE"), info, ["POS"])
    return round_columns(joined, ["BETA", "SE", "MAF"])


@query("meta_fixed", sql_with("assoc", meta_select([]), **meta_ctes("assoc", [])))
def meta_fixed(spark, path):
    return _meta_out(M.meta_fixed(stored(Tables(spark, path).assoc()), []), [])


@query("meta_genomic_control", sql_with("assoc", meta_select([]), **GC_CTES, **meta_ctes("gcassoc", [])))
def meta_genomic_control(spark, path):
    return _meta_out(M.meta_fixed(stored(Tables(spark, path).assoc()), [], gc=True), [])


@query("meta_by_test", sql_with("assoc_tests", meta_select(BY), **meta_ctes("assoc_tests", BY)))
def meta_by_test(spark, path):
    return _meta_out(pooled_tests(Tables(spark, path)), BY)


_RULES = {
    "a": "m.HetDf > t.thr",
    "b": "m.HetDf >= t.thr",
    "c": "m.HetDf >= t.thr AND m.HetDf > 0 AND m.MaxFreq - m.MinFreq < 0.15 AND m.Freq1 > 0.05 AND m.Freq1 < 0.95",
}


def _filtered_sql(rule: str) -> str:
    return f"""SELECT m.* FROM meta m JOIN thr t ON m.MODEL = t.MODEL AND m.OUTCOME = t.OUTCOME
 WHERE m.HetISq < 80 AND {_RULES[rule]}"""


def _register_filter(rule: str) -> None:
    sql = sql_with(
        "assoc_tests", meta_select(BY, "kept"), **meta_ctes("assoc_tests", BY), thr=THRESHOLDS,
        kept=_filtered_sql(rule),
    )

    @query(f"meta_filtered_{rule}", sql)
    def run(spark, path):
        t = Tables(spark, path)
        results = stored(t.assoc_tests())
        counts = M.cohort_counts(results)
        return _meta_out(M.filter_meta(M.meta_fixed(results), counts, rule), BY)


for _rule in _RULES:
    _register_filter(_rule)


@query("cohort_counts", sql_with("manifest", """SELECT TYPE, OUTCOME, CAST(count(DISTINCT DATASET) AS BIGINT) AS N_COHORTS,
 CAST(count(DISTINCT DATASET) // 2 AS BIGINT) AS THRESHOLD FROM manifest GROUP BY 1, 2"""))
def cohort_counts(spark, path):
    return M.cohort_counts(Tables(spark, path).manifest(), ["TYPE", "OUTCOME"])


@query("fold_single_visit", sql_with("assoc_tests", f"""SELECT CASE WHEN MODEL = 'lnmxs' THEN 'lnmxs_intcp' ELSE MODEL END AS MODEL,
 OUTCOME, DATASET, POS, {rnd('BETA')} AS BETA FROM assoc_tests"""))
def fold_single_visit(spark, path):
    t = Tables(spark, path).assoc_tests()
    # One outcome plays the single-visit cohort, the other two the mixed model.
    single = t.where(F.col("MODEL") == "lnmxs").where(F.col("OUTCOME") == "A").withColumn("MODEL", F.lit("lnsgl"))
    mixed = t.where(F.col("MODEL") == "lnmxs").where(F.col("OUTCOME") != "A").withColumn("MODEL", F.lit("lnmxi"))
    rest = t.where(F.col("MODEL") != "lnmxs")
    folded = A.fold_models(rest.unionByName(single).unionByName(mixed))
    return round_columns(folded.select("MODEL", "OUTCOME", "DATASET", "POS", "BETA"), ["BETA"])


@query("fold_one_source_per_cohort", sql_with("assoc_tests", f"""SELECT 'lnmxs_intcp' AS MODEL, OUTCOME, DATASET, POS,
 {rnd("CASE WHEN DATASET = 'S0' THEN 3 * BETA ELSE BETA END")} AS BETA FROM assoc_tests WHERE MODEL = 'lnmxs'"""))
def fold_one_source_per_cohort(spark, path):
    """Three models offer the pooled term; each cohort gives one of them."""
    t = Tables(spark, path).assoc_tests().where(F.col("MODEL") == "lnmxs")
    own = t.where(F.col("DATASET") == "S0").withColumns({"MODEL": F.lit("lnmxs_intcp"), "BETA": 3 * F.col("BETA")})
    single = t.withColumns({"MODEL": F.lit("lnsgl"), "BETA": 2 * F.col("BETA")})
    folded = A.fold_models(own.unionByName(single).unionByName(t.withColumn("MODEL", F.lit("lnmxi"))))
    return round_columns(folded.select("MODEL", "OUTCOME", "DATASET", "POS", "BETA"), ["BETA"])


@query("harmonise_left_join", sql_with("assoc info", f"""SELECT DATASET, POS,
 CASE WHEN f <= 0.5 THEN A1 WHEN f > 0.5 THEN A2 END AS MINOR_ALLELE, CASE WHEN f <= 0.5 THEN A2 WHEN f > 0.5 THEN A1 END AS MAJOR_ALLELE,
 {rnd('CASE WHEN f <= 0.5 THEN BETA WHEN f > 0.5 THEN -BETA END')} AS BETA, {rnd('SE')} AS SE,
 {rnd('CASE WHEN f <= 0.5 THEN f WHEN f > 0.5 THEN 1 - f END')} AS MAF FROM (SELECT a.DATASET, a.POS, a.A1, a.A2, a.BETA, a.SE, i.ALT_FRQ AS f
 FROM assoc a LEFT JOIN (SELECT SNP, A1, ALT_FRQ FROM info WHERE RSQ >= 0.5) i ON a.POS = i.SNP AND a.A1 = i.A1)"""))
def harmonise_left_join(spark, path):
    """Results without a described variant keep their row, and no orientation."""
    t = Tables(spark, path)
    info = t.info().where(F.col("RSQ") >= 0.5).select(F.col("SNP").alias("POS"), "A1", "ALT_FRQ")
    joined = A.join_info(t.assoc().drop("ALT_FRQ", "RSQ"), info, ["POS", "A1"], "left")
    return round_columns(A.to_minor_allele(joined), ["BETA", "SE", "MAF"]).select(
        "DATASET", "POS", "MINOR_ALLELE", "MAJOR_ALLELE", "BETA", "SE", "MAF")


@query("refine_quality", sql_with("assoc", f"SELECT DATASET, POS, {rnd('RSQ')} AS RSQ FROM assoc WHERE RSQ > 0.8"))
def refine_quality(spark, path):
    kept = G.refine_quality(Tables(spark, path).assoc())
    return round_columns(kept.select("DATASET", "POS", "RSQ"), ["RSQ"])


@query("swap_alleles", sql_with("assoc", f"SELECT DATASET, POS, A2 AS A1, A1 AS A2, {rnd('BETA')} AS BETA FROM assoc"))
def swap_alleles(spark, path):
    return round_columns(A.swap_alleles(Tables(spark, path).assoc()).select("DATASET", "POS", "A1", "A2", "BETA"), ["BETA"])


@query("packed_keys", sql_with("assoc", """SELECT POS || '_' || A2 || '_' || A1 AS KEY, POS, A2, A1, CAST(count(*) AS BIGINT) AS N,
 CAST(count(*) AS VARCHAR) || '_' || CAST(count(DISTINCT DATASET) AS VARCHAR) AS COUNTS, CAST(count(DISTINCT DATASET) AS BIGINT) AS M
 FROM assoc GROUP BY POS, A2, A1"""))
def packed_keys(spark, path):
    """Keys and counts written as one text each, and read back."""
    counted = Tables(spark, path).assoc().groupBy("POS", "A2", "A1").agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("DATASET").alias("_m"))
    packed = counted.select(pack_key(F.col("POS"), F.col("A2"), F.col("A1")).alias("KEY"), pack_counts(F.col("_n"), F.col("_m")).alias("COUNTS"))
    n, m = unpack_counts(F.col("COUNTS"))
    return packed.select("KEY", *[c.alias(k) for k, c in unpack_key(F.col("KEY")).items()], "COUNTS", n.alias("N"), m.alias("M"))


@query("first_line_per_position", sql_with("assoc", "SELECT POS, min(POS || ' ' || A1 || ' ' || A2 || ' ' || DATASET) AS value FROM assoc GROUP BY POS"))
def first_line_per_position(spark, path):
    lines = Tables(spark, path).assoc().select(F.concat_ws(" ", "POS", "A1", "A2", "DATASET").alias("value"))
    return G.by_position_first(lines)


@query("byte_order", sql_with("annot", "SELECT POS, ID, CAST(row_number() OVER (ORDER BY POS) AS BIGINT) AS PLACE FROM annot"))
def byte_order(spark, path):
    """Places in the byte order of the position text, kept through a sorted hand-out of ranges."""
    from cohortscan.operators.ordered import global_rank

    ranked = global_rank(Tables(spark, path).annot().select("POS", "ID"), [], ["POS"], "PLACE")
    return P.byte_order(ranked).select("POS", "ID", F.col("PLACE").cast("long").alias("PLACE"))


@query("annotated_above", sql_with("assoc_tests annot", f"""SELECT m.MODEL, m.OUTCOME, m.POS, a.ID, {rnd('m.Freq1')} AS Freq1 FROM meta m JOIN annot a
 ON m.POS = a.POS WHERE m.Freq1 > 0.50123""", **meta_ctes("assoc_tests", BY)))
def annotated_above(spark, path):
    t = Tables(spark, path)
    kept = P.above(P.annotate(pooled_tests(t), t.annot().select("POS", "ID")), "Freq1", 0.50123)
    return round_columns(kept.select("MODEL", "OUTCOME", "POS", "ID", "Freq1"), ["Freq1"])


# --------------------------------------------------------------- post-analysis
HIT_P = 0.005
HIT_BAR = 2.301029995663981


@query("genome_wide_hits", sql_with("assoc_tests", f"""SELECT CAST(count(*) AS BIGINT) AS N_ROWS, CAST(count(DISTINCT POS) AS BIGINT) AS N_POSITIONS,
 {rnd('max(NEGLOG10P)')} AS BEST FROM meta WHERE NEGLOG10P > {HIT_BAR!r}""", **meta_ctes("assoc_tests", BY)))
def genome_wide_hits(spark, path):
    found = P.hits(pooled_tests(Tables(spark, path)), HIT_P)
    return found.agg(
        F.count(F.lit(1)).alias("N_ROWS"), F.countDistinct("POS").alias("N_POSITIONS"),
        rounded(F.max("NEGLOG10P")).alias("BEST"),
    )


@query("hit_list", sql_with("assoc_tests annot", f"""SELECT POS FROM (SELECT POS FROM meta WHERE NEGLOG10P > {HIT_BAR!r} UNION
 SELECT POS FROM annot WHERE FXNCLASS = 'ECONOMY')""", **meta_ctes("assoc_tests", BY)))
def hit_list(spark, path):
    t = Tables(spark, path)
    meta = checkpointed(pooled_tests(t))
    parts = [meta.where(F.col("MODEL") == m) for m in ("coxhm", "lnmxs")]
    return P.variant_list(P.hit_positions(parts, HIT_P), t.annot().where(F.col("FXNCLASS") == "ECONOMY"))


@query("hit_lookup", sql_with("assoc_tests", f"""SELECT DATASET, MODEL, OUTCOME, POS, {rnd('BETA')} AS BETA, {rnd('SE')} AS SE FROM assoc_tests
 WHERE POS IN (SELECT POS FROM meta WHERE NEGLOG10P > {HIT_BAR!r})""", **meta_ctes("assoc_tests", BY)))
def hit_lookup(spark, path):
    results = stored(Tables(spark, path).assoc_tests())
    found = P.lookup(results, P.hit_positions([M.meta_fixed(results)], HIT_P))
    return round_columns(found.select("DATASET", "MODEL", "OUTCOME", "POS", "BETA", "SE"), ["BETA", "SE"])


@query("forest_rows", sql_with("assoc_tests", f"""SELECT DATASET, MODEL, OUTCOME, POS, {rnd('BETA')} AS BETA, {rnd('SE')} AS SE
 FROM assoc_tests WHERE POS = '8:7'"""))
def forest_rows(spark, path):
    found = P.forest_rows(Tables(spark, path).assoc_tests(), "8:7")
    return round_columns(found.select("DATASET", "MODEL", "OUTCOME", "POS", "BETA", "SE"), ["BETA", "SE"])


@query("top_hits", sql_with("assoc_tests", f"""SELECT MODEL, OUTCOME, POS, {rnd('NEGLOG10P')} AS NEGLOG10P FROM
 (SELECT * FROM meta WHERE MODEL = 'coxhm' AND OUTCOME = 'A' ORDER BY NEGLOG10P DESC, POS LIMIT 20)""", **meta_ctes("assoc_tests", BY)))
def top_hits(spark, path):
    one = pooled_tests(Tables(spark, path)).where((F.col("MODEL") == "coxhm") & (F.col("OUTCOME") == "A"))
    return round_columns(P.top_hits(one, 20).select("MODEL", "OUTCOME", "POS", "NEGLOG10P"), ["NEGLOG10P"])


_TESTS = ["A_coxhm", "A_lnmxs", "N_coxhm", "N_lnmxs", "R_coxhm", "R_lnmxs"]


@query("p_crosstab", sql_with("assoc_tests", "SELECT POS, " + ", ".join(
    f"{rnd(f'''max(CASE WHEN OUTCOME || '_' || MODEL = '{c}' THEN NEGLOG10P END)''')} AS {c}" for c in _TESTS
) + " FROM meta GROUP BY POS", **meta_ctes("assoc_tests", BY)))
def p_crosstab(spark, path):
    return round_columns(P.crosstab(pooled_tests(Tables(spark, path)), _TESTS), _TESTS)


@query("p_crosstab_subset", sql_with("assoc_tests", "SELECT POS, " + ", ".join(
    f"{rnd(f'''max(CASE WHEN OUTCOME || '_' || MODEL = '{c}' THEN NEGLOG10P END)''')} AS {c}" for c in _TESTS if "lnmxs" not in c
) + " FROM meta WHERE MODEL <> 'lnmxs' GROUP BY POS", **meta_ctes("assoc_tests", BY)))
def p_crosstab_subset(spark, path):
    kept = P.without_tests(pooled_tests(Tables(spark, path)), "lnmxs", "slope")
    tests = [t for t in _TESTS if "lnmxs" not in t]
    return round_columns(P.crosstab(kept, tests), tests)


@query("p_crosstab_long", sql_with("assoc_tests", f"SELECT POS, OUTCOME || '_' || MODEL AS TEST, {rnd('max(NEGLOG10P)')} AS NEGLOG10P FROM meta GROUP BY 1, 2",
                                   **meta_ctes("assoc_tests", BY)))
def p_crosstab_long(spark, path):
    """The cross-tab of any number of tests."""
    return round_columns(P.crosstab(pooled_tests(Tables(spark, path))), ["NEGLOG10P"])


@query("annotate", sql_with("assoc_tests annot", f"""SELECT m.MODEL, m.OUTCOME, m.POS, a.ID, a.FXNCLASS,
 m.POS || '[' || a.ID || '] ' || a.NEAR_GENE AS LABEL, CAST(split_part(m.POS, ':', 1) AS INTEGER) AS CHR,
 CAST(split_part(m.POS, ':', 2) AS BIGINT) AS BP, {rnd('m.NEGLOG10P')} AS NEGLOG10P
 FROM meta m JOIN annot a ON m.POS = a.POS""", **meta_ctes("assoc_tests", BY)))
def annotate(spark, path):
    from cohortscan.functions.columns import base_pair, chromosome

    t = Tables(spark, path)
    named = P.genomic_order(P.label_rows(P.annotate(pooled_tests(t), t.annot())))
    return named.select(
        "MODEL", "OUTCOME", "POS", "ID", "FXNCLASS", "LABEL", chromosome(F.col("POS")).alias("CHR"),
        base_pair(F.col("POS")).alias("BP"), rounded(F.col("NEGLOG10P")).alias("NEGLOG10P"),
    )


@query("predictors_outer", sql_with("assoc annot", """SELECT coalesce(a.POS, r.POS) AS POS, a.ID, r.N_COHORTS FROM annot a
 FULL JOIN (SELECT POS, CAST(count(*) AS BIGINT) AS N_COHORTS FROM assoc GROUP BY 1) r ON a.POS = r.POS"""))
def predictors_outer(spark, path):
    t = Tables(spark, path)
    tested = t.assoc().groupBy("POS").agg(F.count(F.lit(1)).alias("N_COHORTS"))
    return P.predictors_with_results(t.annot().select("POS", "ID"), tested)


@query("row_hits", sql_with("assoc_tests", f"""SELECT POS, CAST(sum(CASE WHEN NEGLOG10P > {HIT_BAR!r} THEN 1 ELSE 0 END) AS BIGINT) AS N_HITS
 FROM meta GROUP BY POS HAVING sum(CASE WHEN NEGLOG10P > {HIT_BAR!r} THEN 1 ELSE 0 END) > 0""", **meta_ctes("assoc_tests", BY)))
def row_hits(spark, path):
    return P.row_hits(pooled_tests(Tables(spark, path)), HIT_BAR)


_TIER_SQL = """SELECT m.MODEL, m.OUTCOME, m.POS, nt.N_TESTS, nv.N_VARIANTS,
 1 + CAST(NEGLOG10P > -log10(0.05::DOUBLE) AS INTEGER)
 + CAST(NEGLOG10P > -log10(0.05::DOUBLE) + log10(N_TESTS) AS INTEGER)
 + CAST(NEGLOG10P > -log10(0.05::DOUBLE) + log10(N_VARIANTS) AS INTEGER)
 + CAST(NEGLOG10P > -log10(0.05::DOUBLE) + log10(N_TESTS) + log10(N_VARIANTS) AS INTEGER) AS TIER
 FROM meta m JOIN (SELECT POS, CAST(count(NEGLOG10P) AS BIGINT) AS N_TESTS FROM meta GROUP BY 1) nt ON m.POS = nt.POS
 JOIN (SELECT MODEL, OUTCOME, CAST(count(NEGLOG10P) AS BIGINT) AS N_VARIANTS FROM meta GROUP BY 1, 2) nv
 ON m.MODEL = nv.MODEL AND m.OUTCOME = nv.OUTCOME"""


@query("tiers_bonferroni", sql_with("assoc_tests", _TIER_SQL, **meta_ctes("assoc_tests", BY)))
def tiers_bonferroni(spark, path):
    return P.tiers(pooled_tests(Tables(spark, path))).select(
        "MODEL", "OUTCOME", "POS", "N_TESTS", "N_VARIANTS", "TIER"
    )


def _cut(p: str) -> str:
    return f"-log10({p})"


@query("tiers_fixed", sql_with("assoc_tests", f"""SELECT MODEL, OUTCOME, POS, CASE WHEN NEGLOG10P <= {_cut('0.05::DOUBLE')} THEN 1
 WHEN NEGLOG10P <= {_cut('0.05::DOUBLE/40')} THEN 2 WHEN NEGLOG10P <= {_cut('0.05::DOUBLE/92')} THEN 3
 WHEN NEGLOG10P <= {_cut('0.05::DOUBLE/92/40')} THEN 4 ELSE 5 END AS TIER FROM meta""", **meta_ctes("assoc_tests", BY)))
def tiers_fixed(spark, path):
    return P.fixed_tiers(pooled_tests(Tables(spark, path))).select("MODEL", "OUTCOME", "POS", "TIER")


@query("tier_counts", sql_with("assoc_tests", "SELECT MODEL, OUTCOME, TIER, CAST(count(*) AS BIGINT) AS N FROM tiers GROUP BY 1, 2, 3",
                               **meta_ctes("assoc_tests", BY), tiers=_TIER_SQL))
def tier_counts(spark, path):
    return P.tiers(pooled_tests(Tables(spark, path))).groupBy("MODEL", "OUTCOME", "TIER").agg(
        F.count(F.lit(1)).alias("N")
    )


@query("qq_points", sql_with("assoc_tests", f"""SELECT MODEL, OUTCOME, RANK, {rnd('OBSERVED')} AS OBSERVED,
 {rnd('-log10(RANK / (N + 1.0::DOUBLE))')} AS EXPECTED FROM (SELECT MODEL, OUTCOME, NEGLOG10P AS OBSERVED,
 row_number() OVER (PARTITION BY MODEL, OUTCOME ORDER BY NEGLOG10P DESC, POS) AS RANK,
 count(*) OVER (PARTITION BY MODEL, OUTCOME) AS N FROM meta)""", **meta_ctes("assoc_tests", BY)))
def qq_points(spark, path):
    points = P.qq_points(pooled_tests(Tables(spark, path)))
    return round_columns(points.select("MODEL", "OUTCOME", "RANK", "OBSERVED", "EXPECTED"), ["OBSERVED", "EXPECTED"])


@query("manhattan_points", sql_with("assoc_tests", f"""SELECT MODEL, OUTCOME, POS, CHR, BP, BP + CAST(OFS AS BIGINT) AS GENOME_X,
 {rnd('NEGLOG10P')} AS NEGLOG10P FROM g JOIN (SELECT CHR, coalesce(sum(LEN) OVER (ORDER BY CHR ROWS BETWEEN UNBOUNDED PRECEDING
 AND 1 PRECEDING), 0) AS OFS FROM (SELECT CHR, max(BP) AS LEN FROM g GROUP BY 1)) o USING (CHR)""",
    **meta_ctes("assoc_tests", BY),
    g="SELECT *, CAST(split_part(POS, ':', 1) AS INTEGER) AS CHR, CAST(split_part(POS, ':', 2) AS BIGINT) AS BP FROM meta"))
def manhattan_points(spark, path):
    return round_columns(P.manhattan_points(pooled_tests(Tables(spark, path)), max_lambda=None), ["NEGLOG10P"])


def quantile_sql(p: str) -> str:
    """Upper normal quantile of p < 0.5 by Newton steps from 0, which never overshoot on a convex tail."""
    tail = f"0.5 * exp({log_erfc_sql('(z / sqrt(2.0::DOUBLE))')})"
    return f"""list_reduce(list_transform(range(0, 40), lambda k: 0.0::DOUBLE),
 lambda z, k: z + ({tail} - {p}) * sqrt(2 * pi()) * exp(z * z / 2))"""


@query("lambda_gc", sql_with("assoc_tests", f"""SELECT MODEL, OUTCOME, N_VARIANTS, {rnd('MEDIAN_P')} AS MEDIAN_P,
 {rnd(f"power({quantile_sql('(MEDIAN_P / 2)')}, 2) / {CHI2_MEDIAN}::DOUBLE")} AS LAMBDA FROM (
 SELECT MODEL, OUTCOME, CAST(count(*) AS BIGINT) AS N_VARIANTS, quantile_cont(power(10.0::DOUBLE, -NEGLOG10P), 0.5) AS MEDIAN_P
 FROM meta GROUP BY 1, 2)""", **meta_ctes("assoc_tests", BY)))
def lambda_gc(spark, path):
    return round_columns(P.lambda_gc(pooled_tests(Tables(spark, path))), ["MEDIAN_P", "LAMBDA"])


@query("cohort_lambda", sql_with("assoc", f"""SELECT DATASET, N_VARIANTS, {rnd('MEDIAN_P')} AS MEDIAN_P,
 {rnd(f"power({quantile_sql('(MEDIAN_P / 2)')}, 2) / {CHI2_MEDIAN}::DOUBLE")} AS LAMBDA FROM (
 SELECT DATASET, CAST(count(*) AS BIGINT) AS N_VARIANTS, quantile_cont(power(10.0::DOUBLE, -{nlp_sql('(BETA / SE)')}), 0.5) AS MEDIAN_P
 FROM assoc WHERE ALT_FRQ > 0.1 GROUP BY 1)"""))
def cohort_lambda(spark, path):
    common = Tables(spark, path).assoc().where(F.col("ALT_FRQ") > 0.1)
    p = common.withColumn("P", two_sided_p(F.col("BETA") / F.col("SE")))
    return round_columns(P.lambda_gc(p, ["DATASET"]), ["MEDIAN_P", "LAMBDA"])


@query("plot_bounds", sql_with("assoc_tests", f"""SELECT MODEL, OUTCOME, {rnd('greatest(max(NEGLOG10P), 10)')} AS Y_MAX,
 CAST(count(*) AS BIGINT) AS N_POINTS FROM meta GROUP BY 1, 2""", **meta_ctes("assoc_tests", BY)))
def plot_bounds(spark, path):
    return round_columns(P.plot_bound(pooled_tests(Tables(spark, path))), ["Y_MAX"])


@query("score_rows_split", sql_with("assoc", f"""SELECT CASE WHEN POS LIKE '7:%' THEN 'META5' ELSE POS END AS POS, DATASET,
 {rnd(nlp_sql('(BETA / SE)'))} AS NEGLOG10P FROM assoc"""))
def score_rows_split(spark, path):
    # Rows of one chromosome play the score rows (their key is not CHR:BP).
    named = Tables(spark, path).assoc().select(
        F.when(F.col("POS").startswith("7:"), "META5").otherwise(F.col("POS")).alias("POS"), "DATASET",
        rounded(neglog10_p(F.col("BETA") / F.col("SE"))).alias("NEGLOG10P"),
    )
    variants, scores = P.split_scores(named)
    return P.append_scores(variants, scores)


def flagship(spark, path) -> DataFrame:
    """Cohort results to tiers: pool, filter, count tests, grade."""
    t = Tables(spark, path)
    results = stored(t.assoc_tests())
    kept = M.filter_meta(M.meta_fixed(results), M.cohort_counts(results), "b")
    graded = P.tiers(kept)
    return round_columns(
        graded.select("MODEL", "OUTCOME", "POS", "Effect", "StdErr", "NEGLOG10P", "HetDf", "N_TESTS", "N_VARIANTS", "TIER"),
        ["Effect", "StdErr", "NEGLOG10P"],
    )


query("associate_and_tier", sql_with(
    "assoc_tests", f"""SELECT k.MODEL, k.OUTCOME, k.POS, {rnd('k.Effect')} AS Effect, {rnd('k.StdErr')} AS StdErr,
 {rnd('k.NEGLOG10P')} AS NEGLOG10P, k.HetDf, g.N_TESTS, g.N_VARIANTS, g.TIER FROM kept k JOIN graded g
 ON k.MODEL = g.MODEL AND k.OUTCOME = g.OUTCOME AND k.POS = g.POS""",
    **meta_ctes("assoc_tests", BY), thr=THRESHOLDS, kept=_filtered_sql("b"),
    graded=_TIER_SQL.replace("FROM meta", "FROM kept"),
))(flagship)
