"""Readers of the study's text and Parquet inputs.

Schemas are fixed, "NA" is NULL, and the cohort or chromosome of a file comes
from its path.  Wide genotype text is never turned into thousands of columns:
its header becomes an index table and its values an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortscan import schemas as S
from cohortscan.operators.bounded import salted_join
from cohortscan.operators.manifest import parse_manifest

FILE = "_metadata.file_path"


def path_part(from_end: int) -> Column:
    """A component of the file path, counted from the end (1 = file name)."""
    parts = F.split(F.col(FILE), "/")
    return F.element_at(parts, F.lit(-from_end))


def folder_value(key: str) -> Column:
    """Value of a ``key=value`` folder of the file path, as partitioned writers lay it out."""
    return F.regexp_extract(F.col(FILE), rf"/{key}=([^/]*)/", 1)


def read_delimited(
    spark: SparkSession, path, schema: T.StructType, sep: str = "\t", header: bool = True
) -> DataFrame:
    """Text table with a fixed schema; gzip files are read as they are."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, nullValue="NA", enforceSchema=True)


def read_samples(spark: SparkSession, path, dataset: Column | None = None) -> DataFrame:
    """(DATASET, IID): first field of space- or tab-separated sample lists.

    The dataset is the folder two levels above the file unless given.
    """
    name = path_part(3) if dataset is None else dataset
    return spark.read.text(path).select(
        name.alias("DATASET"), F.split(F.col("value"), r"[ \t]+")[0].alias("IID")
    )


def read_variant_info(spark: SparkSession, path, dataset: Column | None = None) -> DataFrame:
    """Imputation info of all chromosomes of one or more cohorts."""
    name = path_part(2) if dataset is None else dataset
    return read_delimited(spark, path, S.VARIANT_INFO).select(name.alias("DATASET"), "*")


def read_phenotypes(spark: SparkSession, path) -> DataFrame:
    return read_delimited(spark, path, S.PHENOTYPES, sep=",")


def read_linked_ids(spark: SparkSession, path) -> DataFrame:
    return read_delimited(spark, path, S.LINKED_IDS, sep=",")


def read_paired_ids(spark: SparkSession, path) -> DataFrame:
    """Id pairs of a relatedness report (blank-separated, many other columns)."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    return lines.where(F.col("f")[1] != "IID1").select(
        F.col("f")[1].alias("IID1"), F.col("f")[3].alias("IID2")
    )


def read_eigenvectors(spark: SparkSession, path, dataset: Column | None = None) -> DataFrame:
    """Principal components; columns are taken by position."""
    name = path_part(2) if dataset is None else dataset
    return read_delimited(spark, path, S.EIGENVECTORS).select(name.alias("DATASET"), "*")


def read_regions(spark: SparkSession, path) -> DataFrame:
    return read_delimited(spark, path, S.REGIONS, sep=" ", header=False)


def read_manifest(spark: SparkSession, path, sep: str = ";") -> DataFrame:
    return parse_manifest(spark.read.text(path), sep)


def read_outcome_lists(spark: SparkSession, path) -> DataFrame:
    """First-pipeline manifest ``dataset:covariates:linear:logistic:survival`` to job rows."""
    part = F.split("value", ":")
    rows = spark.read.text(path).where(~F.lower("value").startswith("cohort:"))
    jobs = None
    for i, model in ((2, "lnsgl"), (3, "lgsbl"), (4, "coxhm")):
        one = rows.select(
            F.lit(model).alias("TYPE"), part[0].alias("DATASET"),
            F.explode(F.split(F.get(part, F.lit(i)), ",")).alias("OUTCOME"), F.split(part[1], ",").alias("COV"),
        ).where(F.col("OUTCOME") != "")
        jobs = one if jobs is None else jobs.unionByName(one)
    return jobs


def read_predictors(
    spark: SparkSession, path, positions: list[int], sep: str, names: list[str], header: bool = True
) -> DataFrame:
    """Chosen fields (counted from 1) of a predictor table; ``sep`` is a literal."""
    table = spark.read.csv(path, sep=sep, header=header, nullValue="NA", inferSchema=False)
    return table.select(*[F.col(f"`{table.columns[p - 1]}`").alias(n) for p, n in zip(positions, names)])


def read_weights(spark: SparkSession, path, positions: list[int], sep: str = "\t", header: bool = True) -> DataFrame:
    """Score weights (POS, EFFECT_ALLELE, WEIGHT) from three fields of a table."""
    raw = read_predictors(spark, path, positions, sep, ["POS", "EFFECT_ALLELE", "WEIGHT"], header)
    return raw.select(
        F.regexp_replace("POS", "^chr", "").alias("POS"), F.upper("EFFECT_ALLELE").alias("EFFECT_ALLELE"),
        F.col("WEIGHT").try_cast("double").alias("WEIGHT"),
    ).where(F.col("WEIGHT").isNotNull())


def read_cohort_results(spark: SparkSession, path, names: dict[str, Column] | None = None) -> DataFrame:
    """Per-cohort result tables laid out as DATASET/MODEL/OUTCOME/file, unless ``names`` says otherwise.

    Any number of chunk files of a result is read together; each has its own header line.
    """
    names = names or {"DATASET": path_part(4), "MODEL": path_part(3), "OUTCOME": path_part(2)}
    return read_delimited(spark, path, S.COHORT_RESULT).select(*[c.alias(n) for n, c in names.items()], *S.COHORT_RESULT.names)


def read_meta_tables(spark: SparkSession, path, names: dict[str, Column] | None = None) -> DataFrame:
    """Pooled tables ``MODEL/OUTCOME1.tbl``: model and outcome from the path, unless ``names`` says otherwise."""
    table = read_delimited(spark, path, S.META_RESULT)
    names = names or {"MODEL": path_part(2), "OUTCOME": F.regexp_extract(path_part(1), r"^(.*)\d\.tbl$", 1)}
    return table.select(
        *[c.alias(n) for n, c in names.items()],
        F.col("MarkerName").alias("POS"), F.upper("Allele1").alias("Allele1"), F.upper("Allele2").alias("Allele2"),
        "Freq1", "FreqSE", "MinFreq", "MaxFreq", "Effect", "StdErr", F.col("P-value").alias("P"), "Direction",
        "HetISq", "HetChiSq", "HetDf", "HetPVal",
    )


def discover(spark: SparkSession, path, keys: list[str] | None = None) -> DataFrame:
    """(MODEL, OUTCOME, FILE) of every result file, without reading any content.

    ``keys`` names ``key=value`` folders to take instead, as partitioned writers lay them out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    if keys:
        return files.select(*[F.regexp_extract("path", rf"/{k}=([^/]*)/", 1).alias(k) for k in keys], F.col("path").alias("FILE"))
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, F.lit(-2)).alias("MODEL"),
        F.regexp_extract(F.element_at(parts, F.lit(-1)), r"^([^.]*)", 1).alias("OUTCOME"),
        F.col("path").alias("FILE"),
    )


# ------------------------------------------------------------ wide genotype text
def read_wide_dosages(
    spark: SparkSession, path, id_columns: int = 2, dataset: Column | None = None, sep: str = r"[\t ]"
) -> DataFrame:
    """Samples x variants text (IID, DOSE, variants...) to long rows.

    The header line of each file becomes an index of variant names, joined
    back by file and place, so files with different variants can be read
    together and no table gets wide.
    """
    name = path_part(2) if dataset is None else dataset
    lines = spark.read.text(path).select(name.alias("DATASET"), F.col(FILE).alias("FILE"), "value")
    return parse_wide_dosages(lines, id_columns, sep)


def parse_wide_dosages(lines: DataFrame, id_columns: int = 2, sep: str = r"[\t ]") -> DataFrame:
    """Lines (DATASET, FILE, value), a header among those of each file, to long rows."""
    fields = lines.select("DATASET", "FILE", F.split("value", sep).alias("_f"))
    is_header = F.col("_f")[0].isin("IID", "ID", "FID")
    rest = F.slice("_f", id_columns + 1, 1 << 30)
    names = fields.where(is_header).select("FILE", rest.alias("NAMES"))
    samples = fields.where(~is_header).select("DATASET", "FILE", F.col("_f")[0].alias("IID"), rest.alias("VALUES"))
    return _named_variants(samples, names)


def _named_variants(samples: DataFrame, names: DataFrame) -> DataFrame:
    """Names meet whole sample lines by file, salted, as a file can hold most lines; values are spread afterwards."""
    both = salted_join(samples, names, ["FILE"], "inner")
    cells = both.select("DATASET", "IID", F.explode(F.arrays_zip("NAMES", "VALUES")).alias("c"))
    part = F.split(F.col("c.NAMES"), "_")
    return cells.where(F.col("c.NAMES").isNotNull()).select(
        "DATASET", "IID", part[0].alias("POS"), F.get(part, F.lit(2)).alias("A1"), F.get(part, F.lit(1)).alias("A2"),
        F.col("c.VALUES").try_cast("double").alias("DOSAGE"),
    )


def in_line_order(spark: SparkSession, path) -> DataFrame:
    """Lines of text files with FILE and PLACE: where their split starts in the file, then their place in it.

    Rows of a split come in order and from one task, so the pair sorts the
    lines of a file however many splits it is cut into.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.col(FILE).alias("FILE"), place.alias("PLACE"), "value")


def read_mach_dosages(spark: SparkSession, dose_path, info_path, dataset: Column | None = None) -> DataFrame:
    """``FID->IID DOSE v1 v2 ...`` lines with the variant list of the info file.

    The two files share their name up to the first dot after the chromosome.
    """
    name = path_part(2) if dataset is None else dataset
    stem = lambda c: F.regexp_replace(c, r"\.mach\.(dose|info)(\.gz)?$", "")
    lines = spark.read.text(dose_path).select(name.alias("DATASET"), stem(F.col(FILE)).alias("FILE"), "value")
    return parse_mach_dosages(lines, in_line_order(spark, info_path).withColumn("FILE", stem(F.col("FILE"))))


def parse_mach_dosages(lines: DataFrame, info: DataFrame) -> DataFrame:
    """Dose lines (DATASET, FILE, value) and info lines (FILE, PLACE, value), whose order is that of the doses."""
    fields = info.select("FILE", "PLACE", F.split("value", r"\t").alias("_f")).where(F.col("_f")[0] != "SNP")
    variant = F.struct("PLACE", F.concat_ws("_", F.col("_f")[0], F.col("_f")[1], F.col("_f")[2]).alias("VARIANT"))
    # As long as one dose line, which is a row as well.
    names = fields.groupBy("FILE").agg(F.array_sort(F.collect_list(variant)).alias("_n")).select(
        "FILE", F.col("_n.VARIANT").alias("NAMES"))
    split = F.split(F.regexp_replace("value", "->", "\t"), r"[\t ]+")
    samples = lines.select("DATASET", "FILE", split[1].alias("IID"), F.slice(split, 4, 1 << 30).alias("VALUES"))
    return _named_variants(samples, names)


# --------------------------------------------------------------------------- VCF
def read_vcf(spark: SparkSession, path, dataset: Column | None = None, block: int = 4096) -> DataFrame:
    """Dosage VCF to (DATASET, POS, A1, A2, CHR, BP, SB, IIDS, DOSAGE, GT) array rows.

    One row per variant and sample block: the dosage field of FORMAT gives
    DOSAGE (hard calls where it is absent), GT the allele count.  The sample
    names of the file's header travel as a parallel array.
    """
    name = path_part(2) if dataset is None else dataset
    return parse_vcf(spark.read.text(path).select(name.alias("DATASET"), F.col(FILE).alias("FILE"), "value"), block)


def parse_vcf(lines: DataFrame, block: int = 4096) -> DataFrame:
    """Lines (DATASET, FILE, value), with the #CHROM line of each file, to the same array rows."""
    body = lines.where(~F.col("value").startswith("##")).withColumn("_f", F.split("value", "\t"))
    header = body.where(F.col("value").startswith("#CHROM")).select(
        "FILE", F.slice("_f", 10, 1 << 30).alias("_names")
    )
    rows = body.where(~F.col("value").startswith("#")).select(
        "DATASET", "FILE", F.regexp_replace(F.col("_f")[0], "^chr", "").alias("_c"), F.col("_f")[1].alias("_p"),
        F.col("_f")[3].alias("A2"), F.col("_f")[4].alias("A1"), F.split(F.col("_f")[8], ":").alias("_format"),
        F.slice("_f", 10, 1 << 30).alias("_values"),
    ).withColumns({
        "_ds": F.array_position("_format", "DS").cast("int"), "_gt": F.array_position("_format", "GT").cast("int"),
    })
    joined = salted_join(rows, header, ["FILE"], "inner").withColumn(
        "SB", F.explode(F.sequence(F.lit(0), F.floor((F.size("_values") - 1) / block).cast("int")))
    )
    part = lambda c: F.slice(c, F.col("SB") * block + 1, block)

    def copies(v: Column) -> Column:
        gt = F.get(F.split(v, ":"), F.col("_gt") - 1)
        alleles = F.split(gt, r"[|/]")
        counted = F.size(F.filter(alleles, lambda a: a != "0"))
        return F.when((F.col("_gt") > 0) & ~F.contains(gt, F.lit(".")), counted)

    def dosage(v: Column) -> Column:
        ds = F.get(F.split(v, ":"), F.col("_ds") - 1).try_cast("float")
        return F.when(F.col("_ds") > 0, ds).otherwise(copies(v).cast("float"))

    return joined.select(
        "DATASET", F.concat_ws(":", "_c", "_p").alias("POS"), "A1", "A2", F.col("_c").try_cast("int").alias("CHR"),
        F.col("_p").cast("long").alias("BP"), "SB", part("_names").alias("IIDS"),
        F.transform(part("_values"), dosage).alias("DOSAGE"), F.transform(part("_values"), copies).alias("GT"),
    )


def vcf_long(arrays: DataFrame) -> DataFrame:
    """Array rows to (DATASET, IID, POS, A1, A2, CHR, BP, DOSAGE, GT)."""
    zipped = arrays.select(
        "DATASET", "POS", "A1", "A2", "CHR", "BP", F.explode(F.arrays_zip("IIDS", "DOSAGE", "GT")).alias("z")
    )
    return zipped.select(
        "DATASET", F.col("z.IIDS").alias("IID"), "POS", "A1", "A2", "CHR", "BP",
        F.col("z.DOSAGE").cast("double").alias("DOSAGE"), F.col("z.GT").alias("GT"),
    )


def additive_calls(arrays: DataFrame, listed: DataFrame) -> DataFrame:
    """0/1/2 calls of the listed variants, with the counted and the other allele."""
    kept = arrays.join(listed.select("POS").distinct(), "POS", "left_semi")
    return vcf_long(kept).select("DATASET", "IID", "POS", "A1", "A2", "GT")


# --------------------------------------------------------------------- result store
def read_results(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Partitioned result store; only the named columns are scanned."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def finished_jobs(spark: SparkSession, path: str) -> DataFrame:
    """(TYPE, DATASET, OUTCOME) that have results, from the partition values."""
    return spark.read.parquet(path).select(F.col("MODEL").alias("TYPE"), "DATASET", "OUTCOME").distinct()


def logged_jobs(spark: SparkSession, path: str) -> DataFrame:
    """(TYPE, DATASET, OUTCOME, N_ROWS) of the run log; a run that did not end has no line there."""
    return spark.read.parquet(path).select(F.col("MODEL").alias("TYPE"), "DATASET", "OUTCOME", "N_ROWS")
