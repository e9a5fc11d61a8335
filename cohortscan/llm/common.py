"""Helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python; texts can be long.
BATCH_ROWS = 1000


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, whatever else the table holds.

    An exact name wins over one that differs in case, the first of several
    equal names wins, and columns that are not asked for never clash.
    """
    own = [f"_c{i}" for i in range(len(df.columns))]
    folded = [c.lower() for c in df.columns]
    found = []
    for name in names:
        if name in df.columns:
            at = df.columns.index(name)
        elif name.lower() in folded:
            at = folded.index(name.lower())
        else:
            raise ValueError(f"no column {name} among {df.columns}")
        found.append(F.col(own[at]).alias(name))
    return df.toDF(*own).select(*found)


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def row_key(doc_id: Column, text: Column) -> Column:
    """Hash of id and text, null told apart from any value; only rows that repeat a document share it."""
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)


def id_remainder(column: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % parts).cast("int")


def bounded_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """About ``rows`` rows picked by a hash of ``keys``; never more than twice as many.

    Counting first keeps the pick spread over all partitions and reproducible.
    """
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * 2**32)
    picked = df.where(F.pmod(F.xxhash64(*keys), F.lit(2**32)) < share)
    return picked.limit(2 * rows)


def first_by_hash(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The ``rows`` rows with the least hash of ``keys``: the same ones however the table is laid out."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(rows)


def distinct_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The distinct rows of ``df`` with the ``rows`` least hashes of ``keys``, and that hash as ``_h``.

    Which rows they are depends on their values only.  Just hashes are ranked;
    rows that repeat each other are one before anything moves.
    """
    hashed = df.withColumn("_h", F.xxhash64(*keys))
    last = hashed.select("_h").distinct().orderBy("_h").limit(rows).agg(F.max("_h").alias("last")).first()["last"]
    picked = hashed.where(F.lit(False) if last is None else F.col("_h") <= last)
    return picked.groupBy("_h").agg(F.min(F.struct(*df.columns)).alias("_r")).select("_h", "_r.*")


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), "")


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column laid end to end, and the length of each list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), lengths.astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))
