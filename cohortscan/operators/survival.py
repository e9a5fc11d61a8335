"""Counting-process tables: follow-up windows, intervals, risk sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortscan.operators.bounded import attach_stats
from cohortscan.operators.pheno import one_row_per_visit, unpivot_columns
from cohortscan.schemas import DAYS_PER_YEAR, MIN_EVENTS
from cohortscan.session import checkpointed

SUBJECT = ["DATASET", "OUTCOME", "IID"]


def long_outcomes(visits: DataFrame, outcomes: list[str], carry: list[str]) -> DataFrame:
    """One row per (DATASET, OUTCOME, IID, TSTART) with STATUS and carried covariates."""
    ids = ["DATASET", "IID", "TSTART"] + carry
    long = unpivot_columns(visits, ids, outcomes, "OUTCOME", "STATUS")
    return one_row_per_visit(long.withColumn("STATUS", F.col("STATUS").cast("int")), SUBJECT + ["TSTART"])


def _subject() -> Window:
    """A subject's visits; ``long_outcomes`` left at most one per day."""
    return Window.partitionBy(*SUBJECT)


def windowed_visits(long: DataFrame) -> DataFrame:
    """Visits inside the follow-up window; an unrecorded status there counts as none.

    The window runs from the first observed visit (BEGIN) to the first event
    or, without one, the last observed visit (END).
    """
    seen = F.when(F.col("STATUS").isNotNull(), F.col("TSTART"))
    event = F.when(F.col("STATUS") == 1, F.col("TSTART"))
    own = _subject()
    return (
        long.withColumns(
            {"BEGIN": F.min(seen).over(own), "END": F.coalesce(F.min(event).over(own), F.max(seen).over(own))}
        )
        .where(F.col("TSTART").between(F.col("BEGIN"), F.col("END")))
        .withColumn("STATUS", F.coalesce("STATUS", F.lit(0)))
    )


def intervals(long: DataFrame, years: str | None = "BLDfDIAG") -> DataFrame:
    """(TSTART, TSTOP] rows whose event is the status at the stop visit.

    Time starts at the window's first visit, which shifts the years from
    diagnosis by the same amount.  Follow-up window and next visit share one
    partitioning, so the whole build shuffles the visits once more at most.
    """
    ahead = _subject().orderBy("TSTART")
    rows = windowed_visits(long).withColumns(
        {"_next": F.lead("TSTART").over(ahead), "EVENT": F.lead("STATUS").over(ahead)}
    )
    shifted = {"TSTOP": F.col("_next") - F.col("BEGIN"), "TSTART": F.col("TSTART") - F.col("BEGIN")}
    if years:
        shifted[years] = F.col(years) + F.col("BEGIN") / F.lit(DAYS_PER_YEAR)
    return (
        rows.where(F.col("_next").isNotNull()).withColumns(shifted)
        .where(F.col("TSTART") < F.col("TSTOP")).drop("_next", "STATUS")
    )


def frequent_events(table: DataFrame, more_than: int = MIN_EVENTS) -> DataFrame:
    """Intervals of the (DATASET, OUTCOME) sets that have enough events."""
    counted = attach_stats(table, ["DATASET", "OUTCOME"], N_EVENT=F.sum("EVENT"))
    return counted.where(F.col("N_EVENT") > more_than)


def event_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("DATASET", "OUTCOME").agg(
        F.count(F.lit(1)).alias("N_OBS"), F.sum("EVENT").alias("N_EVENT")
    )


def build_survival(
    visits: DataFrame, outcomes: list[str], carry: list[str], more_than: int = MIN_EVENTS
) -> DataFrame:
    return frequent_events(checkpointed(intervals(long_outcomes(visits, outcomes, carry))), more_than)


def risk_sets(table: DataFrame) -> DataFrame:
    """(DATASET, OUTCOME, TIME, N_EVENT, N_RISK) at every event time.

    At risk at t means TSTART < t <= TSTOP, so N_RISK is the number of stops
    at or after t less the number of starts at or after t: two counts per
    distinct day instead of an interval join.
    """
    keys = ["DATASET", "OUTCOME"]
    marks = F.array(
        F.struct(F.col("TSTOP").alias("TIME"), F.lit(1).alias("STEP"), F.col("EVENT").alias("D")),
        F.struct(F.col("TSTART").alias("TIME"), F.lit(-1).alias("STEP"), F.lit(0).alias("D")),
    )
    per_time = (
        table.select(*keys, F.inline(marks)).groupBy(*keys, "TIME")
        .agg(F.sum("STEP").alias("STEP"), F.sum("D").alias("N_EVENT"))
    )
    onward = Window.partitionBy(*keys).orderBy(F.col("TIME").desc())
    return (
        per_time.withColumn("N_RISK", F.sum("STEP").over(onward.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("N_EVENT") > 0).drop("STEP")
    )
