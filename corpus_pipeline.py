"""Corpus pipeline: the stages that turn raw documents into training tokens.

Each stage works on all documents that its predecessor kept, reread from
Parquet.  Null and empty texts pass the classifier or not by their score like
any other, are never near-duplicates, hold no personal data, have no words and
so no place in the mix.  Rows that repeat a document fall to one in the second
stage; the mix may repeat a document again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortscan.llm.common import table
from cohortscan.llm.jaccard import one_of_each
from cohortscan.llm.mixing import mixed_corpus
from cohortscan.llm.pieces import round_trip
from cohortscan.llm.pii import redacted
from cohortscan.llm.quality import keep_good
from cohortscan.llm.queries import piece_model
from cohortscan.session import checkpoint_dir


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by their kind."""
    return redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_corpus(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the ids and of the decoded text."""
    return round_trip(docs, piece_model())


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram jaccard join", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Classifier, trees and mix are no SQL; a test holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
