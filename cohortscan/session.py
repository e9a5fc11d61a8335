"""Checkpoint folder handling shared by the jobs that must cut lineage."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's own folder; a fresh local one only for local[*] sessions."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        known = tempfile.mkdtemp(prefix="cohortscan-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1):
    """Python gets at most ``rows`` rows at once from plans that run meanwhile; for rows that hold whole matrices."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
