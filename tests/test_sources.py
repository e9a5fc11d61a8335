from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from cohortscan.operators import manifest as M
from cohortscan.sources import readers as R
from cohortscan.sources import writers as W


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".gz":
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_samples_mixed_delimiters(spark, tmp_path):
    put(tmp_path / "A/plink/x.fam", "a1 a1 0 0\na2\ta2\t0\n")
    put(tmp_path / "B/plink/x.fam", "b1 b1 0 0\n")
    got = R.read_samples(spark, str(tmp_path / "*/plink/*.fam"))
    assert rows(got) == [("A", "a1"), ("A", "a2"), ("B", "b1")]


def test_variant_info_gz(spark, tmp_path):
    head = "SNP\tA2\tA1\tALT_Frq\tMAF\tAvgCall\tRsq\tGenotyped\n"
    put(tmp_path / "A/chr1.info.gz", head + "1:100\tG\tA\t0.2\t0.2\t0.9\t0.8\tImputed\n1:200\tG\tA\t0.9\t0.1\t0.9\tNA\tImputed\n")
    got = R.read_variant_info(spark, str(tmp_path / "A/*.info.gz"))
    assert rows(got.select("DATASET", "SNP", "MAF", "RSQ"))[0] == ("A", "1:100", 0.2, 0.8)
    assert got.where("RSQ IS NULL").count() == 1


def test_phenotypes_na(spark, tmp_path):
    from cohortscan.schemas import PHENOTYPES

    names = PHENOTYPES.names
    put(tmp_path / "p.csv", ",".join(names) + "\n" + ",".join(["PPMI", "1", "0"] + ["NA"] * (len(names) - 3)) + "\n")
    row = R.read_phenotypes(spark, str(tmp_path / "p.csv")).first()
    assert row.STUDY_NAME == "PPMI" and row.TSTART == 0.0 and row.CONST is None and row.AGONIST is None


def test_paired_ids_and_regions(spark, tmp_path):
    put(tmp_path / "m.genome", " FID1 IID1 FID2 IID2 RT\n f HBS1 g c1 UN\n")
    assert rows(R.read_paired_ids(spark, str(tmp_path / "m.genome"))) == [("HBS1", "c1")]
    put(tmp_path / "r.txt", "5 44000000 51500000 r1\n")
    assert rows(R.read_regions(spark, str(tmp_path / "r.txt"))) == [(5, 44000000, 51500000, "r1")]


def test_manifest_forms(spark, tmp_path):
    put(tmp_path / "models.txt", "TYPE;DATASET;OUTCOME;COV\nlgsbl;A;CONST;FEMALE,AAO\n")
    got = R.read_manifest(spark, str(tmp_path / "models.txt"))
    assert rows(got) == [("lgsbl", "A", "CONST", ["FEMALE", "AAO"])]
    put(tmp_path / "old.txt", "cohort:covs:lm:glm:surv\nA:FEMALE,AAO:MMSE:CONST,RBD:\n")
    old = R.read_outcome_lists(spark, str(tmp_path / "old.txt"))
    assert rows(old.select("TYPE", "DATASET", "OUTCOME")) == [("lgsbl", "A", "CONST"), ("lgsbl", "A", "RBD"), ("lnsgl", "A", "MMSE")]
    W.export_manifest(got, str(tmp_path / "out"))
    assert rows(R.read_manifest(spark, str(tmp_path / "out"))) == rows(got)


def test_predictors_and_weights(spark, tmp_path):
    put(tmp_path / "meta.tab", "pos\tgene\tallele\tbeta\nchr1:100\tX\ta\t0.5\nchr2:200\tY\tg\tNA\n")
    got = R.read_weights(spark, str(tmp_path / "meta.tab"), [1, 3, 4])
    assert rows(got) == [("1:100", "A", 0.5)]


def test_wide_dosages(spark, tmp_path):
    put(tmp_path / "A/cut1.txt.gz", "ID\tDOSE\t1:100_G_A\t1:200_T_C\ns1\tDOSE\t0.1\t1.9\ns2\tDOSE\tNA\t1.0\n")
    put(tmp_path / "A/cut2.txt.gz", "ID\tDOSE\t2:300_G_A\ns1\tDOSE\t0.7\n")
    got = rows(R.read_wide_dosages(spark, str(tmp_path / "A/*.txt.gz")))
    assert len(got) == 5
    assert ("A", "s1", "1:100", "A", "G", 0.1) in got and ("A", "s1", "2:300", "A", "G", 0.7) in got
    assert ("A", "s2", "1:100", "A", "G", None) in [tuple(r) for r in got]


def test_mach_dosages(spark, tmp_path):
    put(tmp_path / "A/c1.mach.info", "SNP\tAl1\tAl2\tF\n1:100\tG\tA\t0.1\n1:200\tT\tC\t0.2\n")
    put(tmp_path / "A/c1.mach.dose.gz", "f1->s1\tDOSE\t0.1\t1.5\nf2->s2\tDOSE\t0.3\t0.4\n")
    got = rows(R.read_mach_dosages(spark, str(tmp_path / "A/*.dose.gz"), str(tmp_path / "A/*.info")))
    assert got == [
        ("A", "s1", "1:100", "A", "G", 0.1), ("A", "s1", "1:200", "C", "T", 1.5),
        ("A", "s2", "1:100", "A", "G", 0.3), ("A", "s2", "1:200", "C", "T", 0.4),
    ]


@pytest.mark.parametrize("block", [2, 4096])
def test_vcf(spark, tmp_path, block):
    put(tmp_path / "A/chr1.dose.vcf.gz",
        "##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\n"
        "1\t100\trs1\tG\tA\t.\tPASS\t.\tGT:DS\t0|1:0.9\t1|1:2\t.|.:.\n"
        "1\t200\trs2\tT\tC\t.\tPASS\t.\tGT\t0/0\t0/1\t1/1\n")
    arrays = R.read_vcf(spark, str(tmp_path / "A/*.vcf.gz"), block=block)
    assert arrays.count() == (4 if block == 2 else 2)
    got = {(r.POS, r.IID): (r.DOSAGE, r.GT) for r in R.vcf_long(arrays).collect()}
    assert got[("1:100", "s1")] == (pytest.approx(0.9), 1) and got[("1:100", "s2")] == (2.0, 2)
    assert got[("1:100", "s3")] == (None, None) and got[("1:200", "s3")] == (2.0, 2)
    listed = spark.createDataFrame([("1:200",)], "POS string")
    assert R.additive_calls(arrays, listed).count() == 3


def test_meta_tables_and_discovery(spark, tmp_path):
    head = "MarkerName\tAllele1\tAllele2\tFreq1\tFreqSE\tMinFreq\tMaxFreq\tEffect\tStdErr\tP-value\tDirection\tHetISq\tHetChiSq\tHetDf\tHetPVal\n"
    put(tmp_path / "coxhm/HY31.tbl", head + "1:100\ta\tg\t0.1\t0\t0.1\t0.1\t0.5\t0.1\t1e-8\t+?\t0\t0\t0\t1\n")
    row = R.read_meta_tables(spark, str(tmp_path / "*/*.tbl")).first()
    assert (row.MODEL, row.OUTCOME, row.POS, row.Allele1, row.P) == ("coxhm", "HY3", "1:100", "A", 1e-8)
    assert rows(R.discover(spark, str(tmp_path / "*/*.tbl")).select("MODEL", "OUTCOME")) == [("coxhm", "HY31")]


def test_result_store_round_trip_and_audit(spark, tmp_path):
    path = str(tmp_path / "store")
    results = spark.createDataFrame(
        [("lnsgl", "A", "HY", "1:100", "A", "G", 0.5, 0.1, 5.0, 1e-6, 100, 100, None, "OK"),
         ("coxhm", "B", "CONST", "1:200", "A", "G", 0.2, 0.1, 2.0, 0.04, 80, 40, 21, "OK")],
        "MODEL string, DATASET string, OUTCOME string, POS string, A1 string, A2 string, BETA double, SE double, "
        "STAT double, P double, N_OBS long, N_GROUP long, N_EVENT long, STATUS string")
    W.write_results(results, path)
    back = R.read_results(spark, path, ["DATASET", "POS", "BETA"])
    assert rows(back) == [("A", "1:100", 0.5), ("B", "1:200", 0.2)]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<POS:string,BETA:double>" in plan
    planned = spark.createDataFrame([("lnsgl", "A", "HY"), ("lnsgl", "C", "HY")], "TYPE string, DATASET string, OUTCOME string")
    audit = M.audit_jobs(planned, R.finished_jobs(spark, path))
    assert rows(audit.select("DATASET", "SIDE")) == [("B", "finished"), ("C", "planned")]
    packed = {r.POS_A2_A1: r.OBS_N for r in W.packed_results(results).collect()}
    assert packed == {"1:100_G_A": "100_100", "1:200_G_A": "21_80"}
    W.export_tsv(results, str(tmp_path / "tsv"))
    W.export_csv(results, str(tmp_path / "csv"))
    W.export_list(results, str(tmp_path / "list"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).where(F.col("N_EVENT") == "NA").count() == 1


def test_a_stopped_run_repeated_equals_one_run(spark, tmp_path):
    """A job that fails leaves store and log as they were; the repeated one leaves no row twice."""
    schema = "MODEL string, DATASET string, OUTCOME string, POS string, BETA double"
    first = spark.createDataFrame([("m", d, "o", f"1:{i}", float(i)) for d in "AB" for i in range(40)], schema)
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    W.publish(first, store, log)

    def breaks(batches):
        for i, b in enumerate(batches):
            yield b
        raise ValueError("lost half-way")

    second = spark.createDataFrame([("m", d, "o", f"1:{i}", -float(i)) for d in "BC" for i in range(30)], schema)
    with pytest.raises(Exception, match="lost half-way"):
        W.publish(second.repartition(4).mapInArrow(breaks, schema), store, log)
    assert sorted(map(tuple, R.read_results(spark, store, first.columns).collect())) == sorted(map(tuple, first.collect()))
    for _ in range(2):
        W.publish(second, store, log)
    want = first.where("DATASET = 'A'").unionByName(second)
    assert sorted(map(tuple, R.read_results(spark, store, first.columns).collect())) == sorted(map(tuple, want.collect()))
    assert rows(R.logged_jobs(spark, log)) == [("m", "A", "o", 40), ("m", "B", "o", 30), ("m", "C", "o", 30)]
    planned = spark.createDataFrame([("m", d, "o") for d in "ABCD"], "TYPE string, DATASET string, OUTCOME string")
    assert rows(M.audit_jobs(planned, R.logged_jobs(spark, log).drop("N_ROWS")).select("DATASET", "SIDE")) == [("D", "planned")]


def test_line_order_of_a_file_in_several_splits(spark, tmp_path):
    """One info file cut into many splits names the doses as one split does."""
    n = 500
    put(tmp_path / "A/c1.mach.info", "SNP\tAl1\tAl2\tF\n" + "".join(f"1:{i}\tG\tA\t0.1\n" for i in range(n)))
    put(tmp_path / "A/c1.mach.dose", "".join(f"f{s}->s{s}\tDOSE\t" + "\t".join(str(i + s / 10) for i in range(n)) + "\n" for s in range(4)))
    paths = str(tmp_path / "A/*.dose"), str(tmp_path / "A/*.info")
    whole = rows(R.read_mach_dosages(spark, *paths))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(paths[1]).rdd.getNumPartitions() > 8
        assert rows(R.read_mach_dosages(spark, *paths)) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(whole) == 4 * n and all(r[5] == pytest.approx(int(r[2].split(":")[1]) + int(r[1][1:]) / 10) for r in whole)
