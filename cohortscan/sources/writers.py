"""Sinks: a partitioned Parquet store for results and text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.functions.columns import pack_counts, pack_key

LAYOUT = ["MODEL", "DATASET", "OUTCOME"]


def write_results(results: DataFrame, path: str, mode: str = "replace", layout: list[str] | None = None) -> None:
    """Results as MODEL=/DATASET=/OUTCOME= folders.

    ``replace`` stages the new folders beside the store and puts each in the
    place of the one before when the whole job has ended: a job that fails
    changes nothing, and a job that runs again leaves what one run leaves.
    Folders that the results do not name stay as they are.
    The rebalance hint gathers small folders into few files and splits one
    that holds a large share of the rows over many tasks.
    """
    layout = LAYOUT if layout is None else layout
    writer = results.hint("rebalance", *[F.col(c) for c in layout]).write.partitionBy(*layout)
    if mode == "replace":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode(mode).parquet(path)


def publish(results: DataFrame, path: str, log_path: str) -> None:
    """Store results and then log each job that is now complete, with its number of rows.

    The log is written from what the store holds, after it is in place, and
    has one line for a job however often it ran; a run that stops half-way
    is repeated whole, and jobs without a line are those to run.
    """
    jobs = results.select(*LAYOUT).distinct()
    write_results(results, path)
    stored = results.sparkSession.read.parquet(path).join(jobs, LAYOUT, "left_semi")
    counted = stored.groupBy(*LAYOUT).agg(F.count(F.lit(1)).alias("N_ROWS"))
    counted.withColumn("AT", F.current_timestamp()).write.partitionBy(*LAYOUT).mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").parquet(log_path)


def write_meta(meta: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_results(meta, path, mode, ["MODEL", "OUTCOME"])


def export_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=True, nullValue="NA")


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, nullValue="NA")


def export_list(positions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Position list with its header line."""
    positions.select("POS").distinct().write.mode(mode).csv(path, header=True)


def export_manifest(manifest: DataFrame, path: str, mode: str = "overwrite") -> None:
    from cohortscan.operators.manifest import to_text

    header = manifest.sparkSession.createDataFrame([("TYPE;DATASET;OUTCOME;COV",)], "value string")
    header.unionByName(to_text(manifest)).write.mode(mode).text(path)


def packed_results(results: DataFrame) -> DataFrame:
    """Exchange form: packed variant key and packed counts."""
    survival = F.col("N_EVENT").isNotNull()
    counts = F.when(survival, pack_counts(F.col("N_EVENT"), F.col("N_OBS"))).otherwise(
        pack_counts(F.col("N_OBS"), F.col("N_GROUP"))
    )
    return results.where(F.col("STATUS") == "OK").select(
        "MODEL", "DATASET", "OUTCOME", pack_key(F.col("POS"), F.col("A2"), F.col("A1")).alias("POS_A2_A1"),
        counts.alias("OBS_N"), F.col("STAT").alias("Tvalue"), "BETA", "SE", "P",
    )
