"""Fixed schemas and vocabularies.  Nothing here is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# Outcome, covariate and model names of the study.
BINARY_OUTCOMES = [
    "CONST", "DEMENTIA", "DEPR", "DYSKINESIAS", "HY3", "HYPOSMIA",
    "INS", "MOTORFLUX", "RBD", "RL", "SEADL70", "SLEEP",
]
CONTINUOUS_OUTCOMES = [
    "HY", "MMSE", "MOCA", "SEADL",
    "UPDRS_scaled", "UPDRS1_scaled", "UPDRS2_scaled", "UPDRS3_scaled", "UPDRS4_scaled",
]
COVARIATES = ["FEMALE", "YEARSEDUC", "FAMILY_HISTORY", "AAO", "BLDfDIAG", "DOPA", "AGONIST"]
TIME_VARYING = ["YEARfDIAG", "DOPA", "AGONIST"]
PCS = ["PC1", "PC2", "PC3", "PC4", "PC5"]
WIDE_EFFECT_OUTCOMES = ["MMSE", "MOCA", "SEADL"]
MIN_EVENTS = 19
DAYS_PER_YEAR = 365.25

# Long-range regions left out before principal components.
EXCLUDED_REGIONS = [
    (5, 44000000, 51500000, "r1"),
    (6, 25000000, 33500000, "r2"),
    (8, 8000000, 12000000, "r3"),
    (11, 45000000, 57000000, "r4"),
]

# Carrier variants (position, effect allele, weight).
CARRIER_WEIGHTS = [
    ("1:155205634", "C", 1.0),
    ("1:155206037", "A", 10.0),
    ("1:155206167", "T", 100.0),
]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()

SAMPLES = _struct(DATASET=_S, IID=_S)
LINKED_IDS = _struct(FID=_S, IID=_S, Clincal_ID=_S)
PAIRED_IDS = _struct(IID1=_S, IID2=_S)
PHENOTYPES = T.StructType(
    [T.StructField("STUDY_NAME", _S), T.StructField("ID", _S), T.StructField("TSTART", _D)]
    + [T.StructField(c, _I) for c in BINARY_OUTCOMES if c != "SEADL70"]
    + [T.StructField(c, _D) for c in CONTINUOUS_OUTCOMES]
    + [T.StructField(c, _D) for c in COVARIATES[:5] + ["YEARfDIAG"] + COVARIATES[5:]]
)
EIGENVECTORS = T.StructType(
    [T.StructField("FID", _S), T.StructField("IID", _S)] + [T.StructField(c, _D) for c in PCS]
)
VARIANT_INFO = _struct(
    SNP=_S, A2=_S, A1=_S, ALT_FRQ=_D, MAF=_D, AVGCALL=_D, RSQ=_D, GENOTYPED=_S
)
REGIONS = _struct(CHR=_I, START=_L, STOP=_L, NAME=_S)
WEIGHTS = _struct(POS=_S, EFFECT_ALLELE=_S, WEIGHT=_D)
COHORT_RESULT = _struct(
    POS=_S, A1=_S, A2=_S, BETA=_D, SE=_D, P=_D, ALT_FRQ=_D, RSQ=_D
)
META_RESULT = T.StructType(
    [T.StructField(c, _S) for c in ("MarkerName", "Allele1", "Allele2")]
    + [T.StructField(c, _D) for c in ("Freq1", "FreqSE", "MinFreq", "MaxFreq", "Effect", "StdErr", "P-value")]
    + [T.StructField("Direction", _S)]
    + [T.StructField("HetISq", _D), T.StructField("HetChiSq", _D), T.StructField("HetDf", _L), T.StructField("HetPVal", _D)]
)
RSIDS = _struct(POS=_S, ID=_S)
VARIANT_NAMES = _struct(POS=_S, ID=_S, NEAR_GENE=_S)
ANNOTATION = _struct(POS=_S, ID=_S, SYMBOL=_S, SOTERM=_S, FXNCLASS=_S)

VARIANT_KEY = ["POS", "A1", "A2"]
SCAN_KEY = ["DATASET", "OUTCOME"] + VARIANT_KEY
