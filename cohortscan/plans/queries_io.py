"""Queries over readers and sinks: given tables go out as study files, come back through a reader, and must be unchanged."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscan import schemas as S
from cohortscan.operators import assoc as A
from cohortscan.operators import manifest as M
from cohortscan.operators import pheno as P
from cohortscan.operators.ordered import global_rank
from cohortscan.plans.queries_post import round_columns
from cohortscan.plans.registry import query
from cohortscan.plans.views import Tables, rnd, sql_with
from cohortscan.session import checkpoint_dir, checkpointed
from cohortscan.sources import readers as R
from cohortscan.sources import writers as W


def through(spark: SparkSession, run: Callable[[str], DataFrame]) -> DataFrame:
    """Result of ``run(folder)``, kept as a checkpoint; the folder of exchanged files is removed."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/exchange-{uuid.uuid4().hex}"
    try:
        return checkpointed(run(folder))
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_study(df: DataFrame):
    return df.write.partitionBy("STUDY")


def study():
    return R.folder_value("STUDY")


# ---------------------------------------------------------------- readers of files
@query("read_samples", sql_with("subjects", "SELECT DATASET, CAST(IID AS VARCHAR) AS IID FROM subjects"))
def read_samples(spark, path):
    """Sample lists with mixed delimiters, the cohort from the folder."""
    t = Tables(spark, path)
    gap = F.when(F.col("IID") % 2 == 0, "\t").otherwise("  ")
    lines = t.subjects().select(F.col("DATASET").alias("STUDY"), F.concat("IID", gap, "IID", gap, F.lit("0")).alias("value"))

    def run(folder):
        by_study(lines).text(folder)
        return R.read_samples(spark, f"{folder}/STUDY=*", study())

    return through(spark, run)


@query("read_variant_info", sql_with("info", "SELECT DATASET, SNP, A2, A1, ALT_FRQ, CASE WHEN MAF > 0.1 THEN MAF END AS MAF, RSQ FROM info"))
def read_variant_info(spark, path):
    """Compressed info files of several cohorts, missing values as NA."""
    t = Tables(spark, path)
    table = t.info().select(
        F.col("DATASET").alias("STUDY"), "SNP", "A2", "A1", "ALT_FRQ", F.when(F.col("MAF") > 0.1, F.col("MAF")).alias("MAF"),
        F.lit(None).cast("double").alias("AVGCALL"), "RSQ", F.lit("Imputed").alias("GENOTYPED"))

    def run(folder):
        by_study(table).option("compression", "gzip").csv(folder, sep="\t", header=True, nullValue="NA")
        return R.read_variant_info(spark, f"{folder}/STUDY=*", study()).select("DATASET", "SNP", "A2", "A1", "ALT_FRQ", "MAF", "RSQ")

    return through(spark, run)


@query("read_phenotypes", sql_with("sv", """SELECT DATASET AS STUDY_NAME, CAST(IID AS VARCHAR) AS ID, CAST(TSTART AS DOUBLE) AS TSTART, CONST, SLEEP,
 HY AS SEADL, CASE WHEN HY IS NULL THEN NULL WHEN HY <= 70 THEN 1 ELSE 0 END AS SEADL70, CAST(AAO AS DOUBLE) AS AAO FROM sv"""))
def read_phenotypes(spark, path):
    """Phenotype files with the fixed schema; the derived binary outcome keeps NULL."""
    t = Tables(spark, path)
    have = {"STUDY_NAME": F.col("DATASET"), "ID": F.col("IID").cast("string"), "TSTART": F.col("TSTART").cast("double"),
            "CONST": F.col("CONST"), "SLEEP": F.col("SLEEP"), "SEADL": F.col("HY"), "AAO": F.col("AAO").cast("double")}
    table = t.subject_visits().select(*[
        have.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in S.PHENOTYPES.fields])

    def run(folder):
        W.export_csv(table, folder)
        back = P.derive_seadl70(R.read_phenotypes(spark, folder))
        return back.select("STUDY_NAME", "ID", "TSTART", "CONST", "SLEEP", "SEADL", "SEADL70", "AAO")

    return through(spark, run)


@query("read_id_tables", sql_with("subjects", """SELECT 'linked' AS KIND, CAST(IID AS VARCHAR) AS ID1, 'c' || CAST(IID AS VARCHAR) AS ID2 FROM subjects
 UNION ALL SELECT 'paired', 'HBS' || CAST(IID AS VARCHAR), CAST(IID AS VARCHAR) FROM subjects WHERE FEMALE = 1"""))
def read_id_tables(spark, path):
    """The linked id table and the blank-separated pair report."""
    t = Tables(spark, path)
    iid = F.col("IID").cast("string")
    linked = t.subjects().select(iid.alias("FID"), iid.alias("IID"), F.concat(F.lit("c"), iid).alias("Clincal_ID"))
    pairs = t.subjects().where("FEMALE = 1").select(
        F.concat(F.lit("  f   HBS"), iid, F.lit("  g  "), iid, F.lit("   UN  0.99")).alias("value"))
    head = spark.createDataFrame([("  FID1   IID1  FID2  IID2   RT  PI_HAT",)], "value string")

    def run(folder):
        W.export_csv(linked, f"{folder}/linked")
        head.unionByName(pairs).write.text(f"{folder}/pairs")
        one = R.read_linked_ids(spark, f"{folder}/linked").select(F.lit("linked").alias("KIND"), F.col("IID").alias("ID1"), F.col("Clincal_ID").alias("ID2"))
        two = R.read_paired_ids(spark, f"{folder}/pairs").select(F.lit("paired").alias("KIND"), F.col("IID1").alias("ID1"), F.col("IID2").alias("ID2"))
        return one.unionByName(two)

    return through(spark, run)


@query("read_components", sql_with("pcs", f"SELECT DATASET, CAST(IID AS VARCHAR) AS IID, {', '.join(rnd(c) + ' AS ' + c for c in S.PCS)} FROM pcs"))
def read_components(spark, path):
    """Component files; columns are taken by position, whatever their names."""
    t = Tables(spark, path)
    table = t.components().select(F.col("DATASET").alias("STUDY"), F.col("IID").alias("family"), F.col("IID").alias("sample"),
                                  *[F.col(c).alias(f"e{i}") for i, c in enumerate(S.PCS)])

    def run(folder):
        by_study(table).csv(folder, sep="\t", header=True)
        return R.read_eigenvectors(spark, f"{folder}/STUDY=*", study()).select("DATASET", "IID", *S.PCS)

    return round_columns(through(spark, run), S.PCS, 9)


@query("read_weights", """SELECT CAST(1 + p_partkey % 22 AS VARCHAR) || ':' || CAST(p_partkey AS VARCHAR) AS POS, 'A' AS EFFECT_ALLELE,
 CAST(p_retailprice AS DOUBLE) AS WEIGHT FROM part WHERE p_size % 5 <> 0""")
def read_weights(spark, path):
    """Three fields of a predictor table by their places; rows without a weight are left out."""
    key = F.col("p_partkey")
    table = Tables(spark, path).read("part").select(
        F.col("p_name").alias("name"), F.concat(F.lit("chr"), (F.lit(1) + key % 22).cast("string"), F.lit(":"), key.cast("string")).alias("where"),
        F.lit("a").alias("allele"), F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice").cast("double")).alias("beta"))

    def run(folder):
        W.export_tsv(table, folder)
        return R.read_weights(spark, folder, [2, 3, 4])

    return through(spark, run)


_META = """SELECT MODEL, OUTCOME, POS, sum(BETA) / count(*) AS Effect, min(SE) AS StdErr, CAST(count(*) - 1 AS BIGINT) AS HetDf FROM assoc_tests GROUP BY 1, 2, 3"""


def pooled(t: Tables) -> DataFrame:
    return t.assoc_tests().groupBy("MODEL", "OUTCOME", "POS").agg(
        (F.sum("BETA") / F.count(F.lit(1))).alias("Effect"), F.min("SE").alias("StdErr"), (F.count(F.lit(1)) - 1).alias("HetDf"))


@query("read_meta_tables", sql_with("assoc_tests", f"SELECT MODEL, OUTCOME, POS, 'A' AS Allele1, {rnd('Effect')} AS Effect, {rnd('StdErr')} AS StdErr, HetDf FROM ({_META})"))
def read_meta_tables(spark, path):
    """Pooled tables by model and outcome; both come from the folders, alleles are upper-cased."""
    have = {"MarkerName": F.col("POS"), "Allele1": F.lit("a"), "Allele2": F.lit("g"), "Effect": F.col("Effect"),
            "StdErr": F.col("StdErr"), "HetDf": F.col("HetDf")}
    table = pooled(Tables(spark, path)).select("MODEL", "OUTCOME", *[
        have.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in S.META_RESULT.fields])

    def run(folder):
        table.write.partitionBy("MODEL", "OUTCOME").csv(folder, sep="\t", header=True, nullValue="NA")
        names = {k: R.folder_value(k) for k in ("MODEL", "OUTCOME")}
        back = R.read_meta_tables(spark, f"{folder}/MODEL=*/OUTCOME=*", names)
        return back.select("MODEL", "OUTCOME", "POS", "Allele1", "Effect", "StdErr", "HetDf")

    return round_columns(through(spark, run), ["Effect", "StdErr"], 9)


@query("read_cohort_results", sql_with("assoc_tests", f"""SELECT DATASET, MODEL, OUTCOME, POS, A1, A2, {rnd('BETA')} AS BETA, {rnd('SE')} AS SE, {rnd('ALT_FRQ')} AS ALT_FRQ FROM assoc_tests"""))
def read_cohort_results(spark, path):
    """Chunk files of cohort results, each with its header line, read as one table."""
    keys = ["DATASET", "MODEL", "OUTCOME"]
    table = Tables(spark, path).assoc_tests().select(
        *keys, "POS", "A1", "A2", "BETA", "SE", F.lit(None).cast("double").alias("P"), "ALT_FRQ", F.lit(None).cast("double").alias("RSQ"))

    def run(folder):
        table.repartition(3, "POS").write.partitionBy(*keys).csv(folder, sep="\t", header=True, nullValue="NA")
        found = R.read_cohort_results(spark, f"{folder}/DATASET=*/MODEL=*/OUTCOME=*", {k: R.folder_value(k) for k in keys})
        return found.select(*keys, "POS", "A1", "A2", "BETA", "SE", "ALT_FRQ")

    return round_columns(through(spark, run), ["BETA", "SE", "ALT_FRQ"], 9)


# ------------------------------------------------------------------ genotype text
_LONG = "SELECT DATASET, CAST(IID AS VARCHAR) AS IID, POS, A1, A2, {} AS DOSAGE FROM cgeno"


def names_of(t: Tables) -> DataFrame:
    """One row with the variant names POS_A2_A1 in order."""
    named = t.cohort_arrays().variants.select("J", F.concat_ws("_", "POS", "A2", "A1").alias("n"))
    return named.agg(F.transform(F.array_sort(F.collect_list(F.struct("J", "n"))), lambda x: x["n"]).alias("NAMES"))


def dosage_text(array):
    return F.array_join(F.transform(array, lambda x: F.coalesce(x.cast("string"), F.lit("NA"))), "\t")


@query("read_wide_dosages", sql_with("cgeno", _LONG.format(rnd("DOSAGE"))))
def read_wide_dosages(spark, path):
    """Samples by variants text, a header line in each file, to long rows."""
    t = Tables(spark, path)
    rows = t.cohort_arrays().rows
    lines = rows.select("DATASET", F.col("DATASET").alias("FILE"), F.concat_ws("\t", F.col("IID").cast("string"), F.lit("DOSE"), dosage_text(F.col("DOSAGES"))).alias("value"))
    files = rows.select("DATASET").distinct()
    head = names_of(t).select(F.concat(F.lit("IID\tDOSE\t"), F.array_join("NAMES", "\t")).alias("value"))
    heads = files.select("DATASET", F.col("DATASET").alias("FILE"), F.lit(1).alias("k")).join(head.withColumn("k", F.lit(1)), "k").drop("k")
    return round_columns(R.parse_wide_dosages(lines.unionByName(heads)), ["DOSAGE"], 9)


@query("read_mach_dosages", sql_with("cgeno", _LONG.format(rnd("DOSAGE"))))
def read_mach_dosages(spark, path):
    """Dose lines of family->sample with the variant list in a second file."""
    t = Tables(spark, path)
    rows = t.cohort_arrays().rows
    iid = F.col("IID").cast("string")
    lines = rows.select("DATASET", F.col("DATASET").alias("FILE"), F.concat_ws(
        "\t", F.concat(F.lit("f"), iid, F.lit("->"), iid), F.lit("DOSE"), dosage_text(F.col("DOSAGES"))).alias("value"))
    place = F.struct(F.lit(0).cast("long").alias("split"), F.col("J").alias("line"))
    listed = t.cohort_arrays().variants.select(F.explode(F.array(*[F.lit(f"D{i}") for i in range(5)])).alias("FILE"), place.alias("PLACE"),
                                               F.concat_ws("\t", "POS", "A2", "A1", F.lit("0.1")).alias("value"))
    return round_columns(R.parse_mach_dosages(lines, listed), ["DOSAGE"], 9)


def vcf_lines(t: Tables) -> DataFrame:
    """A file for each cohort: a #CHROM line, then a line for each variant with GT:DS of all samples."""
    geno = t.cohort_geno()
    gt = F.when(F.col("DOSAGE").isNull(), "./.").when(F.round("DOSAGE") == 0, "0/0").when(F.round("DOSAGE") == 1, "0|1").otherwise("1/1")
    cell = F.struct("IID", F.concat(gt, F.lit(":"), F.coalesce(F.col("DOSAGE").cast("float").cast("string"), F.lit("."))).alias("v"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["v"]), "\t")
    part = F.split("POS", ":")
    body = geno.groupBy("DATASET", "POS", "A1", "A2").agg(joined.alias("cells")).select("DATASET", F.concat_ws(
        "\t", F.concat(F.lit("chr"), part[0]), part[1], F.lit("."), "A2", "A1", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:DS"), "cells").alias("value"))
    names = F.array_join(F.transform(F.array_sort(F.collect_set("IID")), lambda x: x.cast("string")), "\t")
    head = geno.groupBy("DATASET").agg(F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), names).alias("value"))
    return body.unionByName(head).withColumn("FILE", F.col("DATASET"))


@query("read_vcf", sql_with("cgeno", f"""SELECT DATASET, CAST(IID AS VARCHAR) AS IID, POS, A1, A2, {rnd('CAST(CAST(DOSAGE AS FLOAT) AS DOUBLE)', 6)} AS DOSAGE,
 CAST(round(DOSAGE) AS INTEGER) AS GT FROM cgeno"""))
def read_vcf(spark, path):
    """Dosage lines in blocks of a hundred samples, back to long rows."""
    found = R.vcf_long(R.parse_vcf(vcf_lines(Tables(spark, path)), block=100))
    return round_columns(found.select("DATASET", "IID", "POS", "A1", "A2", "DOSAGE", "GT"), ["DOSAGE"], 6)


@query("additive_calls", sql_with("cgeno annot", """SELECT DATASET, CAST(IID AS VARCHAR) AS IID, POS, A1, A2, CAST(round(DOSAGE) AS INTEGER) AS GT FROM cgeno
 WHERE split_part(POS, ':', 1) IN (SELECT split_part(POS, ':', 1) FROM annot WHERE CAST(split_part(POS, ':', 2) AS BIGINT) <= 9)"""))
def additive_calls(spark, path):
    """Allele counts of listed variants only."""
    t = Tables(spark, path)
    part = F.split("POS", ":")
    chroms = t.annot().where(part[1].cast("long") <= 9).select(part[0].alias("c")).distinct()
    listed = t.cohort_arrays().variants.withColumn("c", part[0]).join(chroms, "c", "left_semi").select("POS")
    return R.additive_calls(R.parse_vcf(vcf_lines(t)), listed)


# ------------------------------------------------------------------------- sinks
@query("result_store", sql_with("assoc_tests", f"SELECT MODEL, OUTCOME, POS, {rnd('BETA')} AS BETA FROM assoc_tests"))
def result_store(spark, path):
    """Partitioned store written twice, as a repeated run does, then read by a few columns."""
    table = Tables(spark, path).assoc_tests()

    def run(folder):
        for _ in range(2):
            W.write_results(table, folder)
        return R.read_results(spark, folder, ["MODEL", "OUTCOME", "POS", "BETA"])

    return round_columns(through(spark, run), ["BETA"], 9)


@query("run_log", sql_with("assoc_tests", """SELECT MODEL AS TYPE, DATASET, OUTCOME, count(*) AS N_ROWS FROM assoc_tests GROUP BY 1, 2, 3"""))
def run_log(spark, path):
    """One line for each finished job, however often it was published."""
    table = Tables(spark, path).assoc_tests()

    def run(folder):
        for _ in range(2):
            W.publish(table, f"{folder}/store", f"{folder}/log")
        return R.logged_jobs(spark, f"{folder}/log")

    return through(spark, run)


@query("unfinished_jobs", sql_with("assoc_tests", """SELECT DISTINCT MODEL AS TYPE, DATASET, OUTCOME, 'planned' AS SIDE FROM assoc_tests WHERE DATASET >= 'S2'"""))
def unfinished_jobs(spark, path):
    """Jobs that the log of a run over half of the cohorts leaves to do."""
    table = Tables(spark, path).assoc_tests()
    planned = table.select(F.col("MODEL").alias("TYPE"), "DATASET", "OUTCOME").distinct()

    def run(folder):
        W.publish(table.where("DATASET < 'S2'"), f"{folder}/store", f"{folder}/log")
        return M.audit_jobs(planned, R.logged_jobs(spark, f"{folder}/log").drop("N_ROWS"))

    return through(spark, run)


@query("discovered_outputs", sql_with("assoc_tests", "SELECT DISTINCT MODEL, OUTCOME FROM assoc_tests"))
def discovered_outputs(spark, path):
    """Models and outcomes from the names of stored folders, without reading a file."""
    def run(folder):
        W.write_meta(pooled(Tables(spark, path)), folder)
        return R.discover(spark, folder, ["MODEL", "OUTCOME"]).select("MODEL", "OUTCOME").distinct()

    return through(spark, run)


@query("text_exports", sql_with("annot", """SELECT 'tsv' AS KIND, POS, ID, CASE WHEN length(NEAR_GENE) % 2 = 0 THEN NEAR_GENE END AS NEAR_GENE FROM annot
 UNION ALL SELECT 'csv', POS, ID, CASE WHEN length(NEAR_GENE) % 2 = 0 THEN NEAR_GENE END FROM annot UNION ALL SELECT DISTINCT 'list', POS, NULL, NULL FROM annot"""))
def text_exports(spark, path):
    """Tab- and comma-separated exports with NA for missing values, and a position list with its header."""
    table = Tables(spark, path).annot().select("POS", "ID", F.when(F.length("NEAR_GENE") % 2 == 0, F.col("NEAR_GENE")).alias("NEAR_GENE"))

    def run(folder):
        W.export_tsv(table, f"{folder}/tsv")
        W.export_csv(table, f"{folder}/csv")
        W.export_list(table, f"{folder}/list")
        tsv = spark.read.csv(f"{folder}/tsv", sep="\t", header=True, nullValue="NA").withColumn("KIND", F.lit("tsv"))
        csv = spark.read.csv(f"{folder}/csv", header=True, nullValue="NA").withColumn("KIND", F.lit("csv"))
        one = spark.read.csv(f"{folder}/list", header=True).withColumn("KIND", F.lit("list"))
        return tsv.unionByName(csv).unionByName(one, allowMissingColumns=True)

    return through(spark, run)


# ---------------------------------------------------- operators that only plans used
@query("usable_results", sql_with("assoc_tests", f"""SELECT DATASET, MODEL, OUTCOME, POS, {rnd('BETA')} AS BETA FROM assoc_tests
 WHERE CAST(split_part(POS, ':', 2) AS BIGINT) % 3 <> 0"""))
def usable_results(spark, path):
    """Fits that failed, which have no P, are left out."""
    failed = F.split("POS", ":")[1].cast("long") % 3 == 0
    table = Tables(spark, path).assoc_tests().withColumns({"P": F.when(~failed, F.lit(0.5)), "STATUS": F.when(failed, "NO_CONVERGE").otherwise("OK")})
    return round_columns(A.drop_failed(table).select("DATASET", "MODEL", "OUTCOME", "POS", "BETA"), ["BETA"], 9)


@query("components_joined", sql_with("subjects pcs", f"""SELECT s.DATASET, s.IID, {', '.join(rnd(c) + ' AS ' + c for c in S.PCS)} FROM subjects s
 LEFT JOIN (SELECT * FROM pcs WHERE IID % 3 <> 0) p ON s.DATASET = p.DATASET AND s.IID = p.IID"""))
def components_joined(spark, path):
    """Subjects with their components; those without any stay, and a sample listed twice counts once."""
    t = Tables(spark, path)
    some = t.components().where(F.col("IID") % 3 != 0)
    joined = P.attach_components(t.subjects().select("DATASET", "IID"), some.unionByName(some))
    return round_columns(joined, S.PCS, 9)


@query("covariates_joined", sql_with("sv subjects", """SELECT v.DATASET, v.IID AS FID, v.IID, v.TSTART, v.CONST, s.AAO, s.FEMALE FROM sv v
 JOIN (SELECT * FROM subjects WHERE YEARSEDUC > 10) s ON v.IID = s.IID"""))
def covariates_joined(spark, path):
    """Phenotype rows and the covariate table, matched on family and sample id."""
    t = Tables(spark, path)
    pheno = t.subject_visits().select("DATASET", F.col("IID").alias("FID"), "IID", "TSTART", "CONST")
    covs = t.subjects().where("YEARSEDUC > 10").select(F.col("IID").alias("FID"), "IID", "AAO", "FEMALE")
    return P.join_covariates(pheno, covs)


@query("visits_in_order", sql_with("sv", """SELECT row_number() OVER (ORDER BY DATASET, IID, TSTART) AS PLACE, DATASET, IID, TSTART FROM sv"""))
def visits_in_order(spark, path):
    """Rows in the order of an export: cohort, subject, time."""
    rows = Tables(spark, path).subject_visits().select("DATASET", "IID", "TSTART")
    return global_rank(rows, [], ["DATASET", "IID", "TSTART"], "PLACE")
