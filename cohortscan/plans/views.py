"""Study-shaped views of the given tables, as DataFrames and as SQL.

Both forms state the same definition; the SQL text is used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscan.models.arrays import SubjectArrays


def _hundredths(column: str):
    return F.round(F.col(column) * 100).cast("long")


def _mean(column: str):
    """Mean of a two-decimal column from an exact integer sum."""
    return F.sum(_hundredths(column)) / F.count(F.lit(1)) / F.lit(100.0)


def _standard_error(column: str):
    """Standard error of that mean (about two percent narrow); NULL for single rows.

    The odd scale keeps pooled values off exact rounding ties.
    """
    x, n = _hundredths(column), F.count(F.lit(1))
    spread = n * F.sum(x * x) - F.sum(x) * F.sum(x)
    return F.when(n > 1, F.sqrt(spread / (n * n * (n - F.lit(1)))) * F.lit(0.99) / F.lit(101.0))


class Tables:
    """Lazy access to the tables of one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def subjects(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(
            key.alias("IID"),
            F.concat(F.lit("D"), (key % 5).cast("string")).alias("DATASET"),
            (F.col("c_nationkey") % 2).cast("int").alias("FEMALE"),
            (F.lit(8) + key % 12).cast("int").alias("YEARSEDUC"),
            (F.col("c_mktsegment") == "BUILDING").cast("int").alias("FAMILY_HISTORY"),
            (F.lit(40) + key % 37).cast("int").alias("AAO"),
            ((key % 50) / F.lit(10.0)).alias("BLDfDIAG"),
        )

    def visits(self) -> DataFrame:
        """One row per (IID, day): the group-by combines map-side, so a hot
        subject shrinks to at most one row per calendar day before it moves."""
        kind, value = F.col("event_type"), F.col("value")

        def flag(cond):
            return F.max(F.when(cond, 1).otherwise(0))

        return (
            self.read("events")
            .groupBy(
                F.col("user_id").alias("IID"),
                F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("TSTART"),
            )
            .agg(
                F.when(flag(kind.isin("error", "view")) == 1, flag((kind == "error") & (value > 100))).alias("CONST"),
                F.when(flag(kind.isin("click", "signup")) == 1, flag((kind == "click") & (value > 150))).alias("SLEEP"),
                F.avg(F.when(kind != "purchase", value)).alias("HY"),
                flag(kind == "purchase").alias("DOPA"),
            )
        )

    def subject_visits(self) -> DataFrame:
        """Visits with the cohort and covariates of their subject."""
        return self.visits().join(self.subjects(), "IID").withColumn(
            "YEARfDIAG", F.col("BLDfDIAG") + F.col("TSTART") / F.lit(365.25)
        )

    def geno(self) -> DataFrame:
        """Long dosage rows; a NULL dosage is a missing call."""
        j = F.col("J")
        return (
            self.read("embeddings")
            .select(F.col("vec_id").alias("IID"), F.posexplode("embedding").alias("J", "X"))
            .select(
                "IID", j,
                (F.lit(1) + j % 22).cast("int").alias("CHR"),
                (F.lit(1000) * (j + 1)).cast("long").alias("BP"),
                F.concat((F.lit(1) + j % 22).cast("string"), F.lit(":"), (F.lit(1000) * (j + 1)).cast("string")).alias("POS"),
                F.when(
                    (F.col("IID") + j) % 29 != 0,
                    F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) + F.lit(4.0) * F.col("X").cast("double"))),
                ).alias("DOSAGE"),
            )
            .withColumn("GT", F.round("DOSAGE").cast("int"))
        )

    def cohort_geno(self) -> DataFrame:
        """Dosages keyed by cohort with allele names, as the scans take them."""
        return self.geno().select(
            F.concat(F.lit("D"), (F.col("IID") % 5).cast("string")).alias("DATASET"),
            "IID", "POS", F.when(F.col("J") % 2 == 0, "A").otherwise("C").alias("A1"),
            F.when(F.col("J") % 3 == 0, "T").otherwise("G").alias("A2"), "DOSAGE",
        )

    def cohort_arrays(self) -> SubjectArrays:
        """The same dosages as one array for each subject, and the variant of each place."""
        iid, clamp = F.col("vec_id"), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) + F.lit(4.0) * x.cast("double")))
        rows = self.read("embeddings").select(
            F.concat(F.lit("D"), (iid % 5).cast("string")).alias("DATASET"), iid.alias("IID"),
            F.transform("embedding", lambda x, j: F.when((iid + j) % 29 != 0, clamp(x))).alias("DOSAGES"),
        )
        j, last = F.col("J"), F.max(F.size("embedding")).cast("long") - 1
        variants = self.read("embeddings").agg(last.alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("J"))
        pos = F.concat((F.lit(1) + j % 22).cast("string"), F.lit(":"), (F.lit(1000) * (j + 1)).cast("string"))
        return SubjectArrays(rows, variants.select(
            j, pos.alias("POS"), F.when(j % 2 == 0, "A").otherwise("C").alias("A1"), F.when(j % 3 == 0, "T").otherwise("G").alias("A2")))

    def call_arrays(self) -> DataFrame:
        """Hard calls (IID, CALLS) as one array for each subject, in the order of J."""
        subject = self.cohort_arrays().rows
        return subject.where(F.size("DOSAGES") > 0).select("IID", F.transform("DOSAGES", lambda x: F.round(x).cast("byte")).alias("CALLS"))

    def components(self) -> DataFrame:
        """Five components of each subject: the last entries of its vector."""
        return self.read("embeddings").select(
            F.concat(F.lit("D"), (F.col("vec_id") % 5).cast("string")).alias("DATASET"), F.col("vec_id").alias("IID"),
            *[F.get(F.reverse("embedding"), F.lit(i)).cast("double").alias(f"PC{i + 1}") for i in range(5)],
        )

    def assoc(self) -> DataFrame:
        """Per-cohort results (DATASET, POS, A1, A2, BETA, SE, ALT_FRQ, RSQ)."""
        cohort, part = F.col("l_suppkey") % 13, F.col("l_partkey")
        even = (cohort + part) % 2 == 0
        return (
            self.read("lineitem")
            .groupBy(
                F.concat(F.lit("S"), cohort.cast("string")).alias("DATASET"),
                F.concat((F.lit(1) + part % 22).cast("string"), F.lit(":"), part.cast("string")).alias("POS"),
                F.when(even, "A").otherwise("G").alias("A1"),
                F.when(even, "G").otherwise("A").alias("A2"),
            )
            .agg(
                (_mean("l_discount") - 0.05).alias("BETA"),
                _standard_error("l_discount").alias("SE"),
                (_mean("l_tax") * 10).alias("ALT_FRQ"),
                (_mean("l_quantity") / 50).alias("RSQ"),
            )
            .where(F.col("SE") > 0)
        )

    def assoc_tests(self) -> DataFrame:
        """Per-cohort results of six tests (three outcomes, two models)."""
        cohort, part = F.col("l_suppkey") % 4, F.col("l_partkey")
        even = (cohort + part) % 2 == 0
        wide = (
            self.read("lineitem")
            .groupBy(
                F.concat(F.lit("S"), cohort.cast("string")).alias("DATASET"),
                F.col("l_returnflag").alias("OUTCOME"),
                F.concat((F.lit(1) + part % 22).cast("string"), F.lit(":"), part.cast("string")).alias("POS"),
                F.when(even, "A").otherwise("G").alias("A1"),
                F.when(even, "G").otherwise("A").alias("A2"),
            )
            .agg(
                (_mean("l_discount") - 0.05).alias("b1"),
                _standard_error("l_discount").alias("s1"),
                (_mean("l_tax") - 0.04).alias("b2"),
                _standard_error("l_tax").alias("s2"),
                (_mean("l_quantity") / 50).alias("ALT_FRQ"),
            )
        )
        both = F.array(
            F.struct(F.lit("coxhm").alias("MODEL"), F.col("b1").alias("BETA"), F.col("s1").alias("SE")),
            F.struct(F.lit("lnmxs").alias("MODEL"), F.col("b2").alias("BETA"), F.col("s2").alias("SE")),
        )
        return wide.select("DATASET", "OUTCOME", "POS", "A1", "A2", "ALT_FRQ", F.inline(both)).where(
            F.col("SE") > 0
        )

    def manifest(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderpriority").alias("TYPE"),
            F.concat(F.lit("D"), (F.col("o_custkey") % 13).cast("string")).alias("DATASET"),
            F.col("o_orderstatus").alias("OUTCOME"),
        ).distinct()

    def annot(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.read("part").select(
            F.concat((F.lit(1) + key % 22).cast("string"), F.lit(":"), key.cast("string")).alias("POS"),
            F.concat(F.lit("rs"), key.cast("string")).alias("ID"),
            F.col("p_name").alias("NEAR_GENE"),
            F.col("p_type").alias("FXNCLASS"),
        )

    def info(self) -> DataFrame:
        """Imputation info of three cohorts (DATASET, SNP, MAF, RSQ, ...)."""
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.read("part").select(
            F.concat(F.lit("D"), (size % 3).cast("string")).alias("DATASET"),
            F.concat((F.lit(1) + key % 22).cast("string"), F.lit(":"), key.cast("string")).alias("SNP"),
            F.lit("G").alias("A2"), F.lit("A").alias("A1"),
            ((key % 100) / F.lit(100.0)).alias("ALT_FRQ"),
            ((size % 50) / F.lit(100.0)).alias("MAF"),
            ((key % 100) / F.lit(100.0)).alias("RSQ"),
        )


def _mean_sql(c: str) -> str:
    return f"sum(CAST(round({c} * 100) AS BIGINT))::DOUBLE / count(*) / 100.0::DOUBLE"


def _se_sql(c: str) -> str:
    x = f"CAST(round({c} * 100) AS BIGINT)"
    spread = f"(count(*) * sum({x} * {x}) - sum({x}) * sum({x}))::DOUBLE"
    return (
        f"CASE WHEN count(*) > 1 THEN sqrt({spread} / (count(*) * count(*) * (count(*) - 1))) "
        "* 0.99::DOUBLE / 101.0::DOUBLE END"
    )


VIEW_SQL = {
    "subjects": """SELECT c_custkey AS IID, 'D' || CAST(c_custkey % 5 AS VARCHAR) AS DATASET,
 CAST(c_nationkey % 2 AS INTEGER) AS FEMALE, CAST(8 + c_custkey % 12 AS INTEGER) AS YEARSEDUC,
 CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS FAMILY_HISTORY, CAST(40 + c_custkey % 37 AS INTEGER) AS AAO,
 (c_custkey % 50) / 10.0 ::DOUBLE AS BLDfDIAG FROM customer""",
    "visits": """SELECT user_id AS IID,
 CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS TSTART,
 CASE WHEN max(CASE WHEN event_type IN ('error','view') THEN 1 ELSE 0 END) = 1
  THEN max(CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END) END AS CONST,
 CASE WHEN max(CASE WHEN event_type IN ('click','signup') THEN 1 ELSE 0 END) = 1
  THEN max(CASE WHEN event_type = 'click' AND value > 150 THEN 1 ELSE 0 END) END AS SLEEP,
 avg(CASE WHEN event_type <> 'purchase' THEN value END) AS HY,
 max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS DOPA
 FROM events GROUP BY 1, 2""",
    "sv": """SELECT v.*, s.DATASET, s.FEMALE, s.YEARSEDUC, s.FAMILY_HISTORY, s.AAO, s.BLDfDIAG,
 s.BLDfDIAG + v.TSTART / 365.25::DOUBLE AS YEARfDIAG FROM visits v JOIN subjects s ON v.IID = s.IID""",
    "geno": """SELECT IID, J, CAST(1 + J % 22 AS INTEGER) AS CHR, CAST(1000 * (J + 1) AS BIGINT) AS BP,
 CAST(1 + J % 22 AS VARCHAR) || ':' || CAST(1000 * (J + 1) AS VARCHAR) AS POS,
 CASE WHEN (IID + J) % 29 <> 0 THEN greatest(0.0::DOUBLE, least(2.0::DOUBLE, 1 + 4 * CAST(X AS DOUBLE))) END AS DOSAGE,
 CASE WHEN (IID + J) % 29 <> 0 THEN CAST(round(greatest(0.0::DOUBLE, least(2.0::DOUBLE, 1 + 4 * CAST(X AS DOUBLE)))) AS INTEGER) END AS GT
 FROM (SELECT vec_id AS IID, unnest(embedding) AS X, generate_subscripts(embedding, 1) - 1 AS J FROM embeddings)""",
    "cgeno": """SELECT 'D' || CAST(IID % 5 AS VARCHAR) AS DATASET, IID, POS, CASE WHEN J % 2 = 0 THEN 'A' ELSE 'C' END AS A1,
 CASE WHEN J % 3 = 0 THEN 'T' ELSE 'G' END AS A2, DOSAGE FROM geno""",
    "pcs": "SELECT 'D' || CAST(vec_id % 5 AS VARCHAR) AS DATASET, vec_id AS IID, " + ", ".join(
        f"CAST(embedding[{-i - 1}] AS DOUBLE) AS PC{i + 1}" for i in range(5)) + " FROM embeddings",
    "assoc": f"""SELECT * FROM (SELECT 'S' || CAST(l_suppkey % 13 AS VARCHAR) AS DATASET,
 CAST(1 + l_partkey % 22 AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) AS POS,
 CASE WHEN (l_suppkey % 13 + l_partkey) % 2 = 0 THEN 'A' ELSE 'G' END AS A1,
 CASE WHEN (l_suppkey % 13 + l_partkey) % 2 = 0 THEN 'G' ELSE 'A' END AS A2,
 {_mean_sql('l_discount')} - 0.05::DOUBLE AS BETA, {_se_sql('l_discount')} AS SE,
 {_mean_sql('l_tax')} * 10 AS ALT_FRQ, {_mean_sql('l_quantity')} / 50 AS RSQ
 FROM lineitem GROUP BY 1, 2, 3, 4) WHERE SE > 0""",
    "assoc_tests": f"""SELECT DATASET, OUTCOME, POS, A1, A2, ALT_FRQ, MODEL, BETA, SE FROM (
 WITH w AS (SELECT 'S' || CAST(l_suppkey % 4 AS VARCHAR) AS DATASET, l_returnflag AS OUTCOME,
 CAST(1 + l_partkey % 22 AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) AS POS,
 CASE WHEN (l_suppkey % 4 + l_partkey) % 2 = 0 THEN 'A' ELSE 'G' END AS A1,
 CASE WHEN (l_suppkey % 4 + l_partkey) % 2 = 0 THEN 'G' ELSE 'A' END AS A2,
 {_mean_sql('l_discount')} - 0.05::DOUBLE AS b1, {_se_sql('l_discount')} AS s1,
 {_mean_sql('l_tax')} - 0.04::DOUBLE AS b2, {_se_sql('l_tax')} AS s2, {_mean_sql('l_quantity')} / 50 AS ALT_FRQ
 FROM lineitem GROUP BY 1, 2, 3, 4, 5)
 SELECT DATASET, OUTCOME, POS, A1, A2, ALT_FRQ, 'coxhm' AS MODEL, b1 AS BETA, s1 AS SE FROM w UNION ALL
 SELECT DATASET, OUTCOME, POS, A1, A2, ALT_FRQ, 'lnmxs', b2, s2 FROM w) WHERE SE > 0""",
    "manifest": """SELECT DISTINCT o_orderpriority AS TYPE, 'D' || CAST(o_custkey % 13 AS VARCHAR) AS DATASET,
 o_orderstatus AS OUTCOME FROM orders""",
    "annot": """SELECT CAST(1 + p_partkey % 22 AS VARCHAR) || ':' || CAST(p_partkey AS VARCHAR) AS POS,
 'rs' || CAST(p_partkey AS VARCHAR) AS ID, p_name AS NEAR_GENE, p_type AS FXNCLASS FROM part""",
    "info": """SELECT 'D' || CAST(p_size % 3 AS VARCHAR) AS DATASET,
 CAST(1 + p_partkey % 22 AS VARCHAR) || ':' || CAST(p_partkey AS VARCHAR) AS SNP, 'G' AS A2, 'A' AS A1,
 (p_partkey % 100) / 100.0::DOUBLE AS ALT_FRQ, (p_size % 50) / 100.0::DOUBLE AS MAF,
 (p_partkey % 100) / 100.0::DOUBLE AS RSQ FROM part""",
}
NEEDS = {"sv": ["visits", "subjects"], "cgeno": ["geno"]}


def sql_with(views: str, body: str, **extra: str) -> str:
    """``WITH`` clause of the named views (and what they need) before a body."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        add(name)
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in ordered] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def rnd(expr: str, digits: int = 9) -> str:
    """SQL rounding without a negative zero."""
    return f"(CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expr}, {digits}) END)"


def log_erfc_sql(x: str) -> str:
    """Log of erfc by the trapezoidal rule, which is exact to rounding for its integrand.

    Shares nothing with the approximation of the library.  Below 0.2 the rule
    cancels, and the power series of erf is summed instead.
    """
    near = f"ln(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 16), lambda k: power(-1.0::DOUBLE, k) * power({x}, 2 * k + 1) / (factorial(CAST(k AS INTEGER)) * (2 * k + 1)))))"
    total = f"0.5 / pi() * ({x}) * (1 / power({x}, 2) + 2 * list_sum(list_transform(range(1, 26), lambda k: exp(-0.25 * k * k) / (0.25 * k * k + power({x}, 2)))))"
    # The pole of the integrand adds a term while it lies within the strip.
    middle = f"ln(({total}) * exp(-power({x}, 2)) + 2 / (1 - exp(4 * pi() * ({x}))))"
    return f"(CASE WHEN {x} < 0.2 THEN {near} WHEN {x} < 4 THEN {middle} ELSE ln({total}) - power({x}, 2) END)"


def nlp_sql(z: str) -> str:
    """-log10 of the two-sided normal P of z."""
    return f"(-{log_erfc_sql(f'(abs({z}) / sqrt(2.0::DOUBLE))')} / ln(10.0::DOUBLE))"
