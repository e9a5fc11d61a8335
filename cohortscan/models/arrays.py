"""Scans over arrays: a fit is a chain of sums over subject blocks.

Dosages are dealt out once, as a (variants x subjects) matrix for each batch of
variants and block of subjects, and meet there with the packed phenotype rows
of the block, which are sent once for each batch.  A fit never looks at
subjects but through sums: ``part`` adds up what a block has to say about the
present state, ``advance`` takes the total and moves on.  Where a cohort has
one block all steps run inside the task that holds it.  A larger cohort keeps
its packed blocks in place, and each step is one aggregation that moves the
state and its sums only; both ways run the same code and give the same result.
A block is bounded by its subjects and its rows, and its sums are taken over
runs of subjects, so neither grows with the visits of a cohort.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from cohortscan.models.design import SET
from cohortscan.operators.bounded import join_small
from cohortscan.schemas import SCAN_KEY, VARIANT_KEY
from cohortscan.session import checkpointed, small_batches

#: Base pairs of a window; dense imputed sets have some hundred variants in it.
WINDOW = 50_000
#: Variants that are fitted together, which bounds the work space of a task.
TOGETHER = 64
#: Subjects of a block: with 64 variants a matrix of 32 MB; and phenotype rows of all its sets, 8 bytes a value.
BLOCK_SUBJECTS, BLOCK_ROWS = 65_536, 131_072
#: Rows of a set whose sums are taken together: with 64 variants 8 MB for each array of a step.
ROWS_TOGETHER = 16_384
#: Subjects whose dosages are put into the matrix at once.
READ_TOGETHER = 8_192


@dataclass
class SubjectArrays:
    """Genotypes as one row for each subject (DATASET, IID, DOSAGES in the order of J), and what each J is.

    Nothing is ever spread to a row for each dosage: subjects are cut into
    slices of ``TOGETHER`` variants.
    """

    rows: DataFrame
    variants: DataFrame  # J and VARIANT_KEY


@dataclass
class Block:
    """Rows of one set in one block beside the dosages of their subjects."""

    dosages: np.ndarray  # variants x subjects of the block, NaN where missing
    place: np.ndarray  # subject of each row
    columns: np.ndarray  # rows x columns
    grid: np.ndarray  # event times of the whole set, where the model has them

    def of_rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Dosages by row with zeros where missing, and what was observed."""
        s = self.dosages[:, self.place]
        seen = ~np.isnan(s)
        return np.where(seen, s, 0.0), seen


class Fit(Protocol):
    """``state`` is a dictionary of arrays; ``finished`` in it ends the fit."""

    columns: list[str]
    outputs: str
    grid: tuple[str, str] | None  # column of event times and of the event, shared by all blocks of a set

    def start(self, variants: int) -> dict: ...
    def part(self, state: dict, block: Block) -> dict[str, np.ndarray]: ...
    def advance(self, state: dict, total: dict[str, np.ndarray]) -> dict: ...
    def output(self, state: dict) -> dict[str, np.ndarray]: ...


def window_of(pos: Column) -> Column:
    """Chromosome and window of ``CHR:BP``; a name that is no position is a window of its own."""
    part = F.split(pos, ":")
    bp = F.get(part, F.lit(1)).try_cast("long")
    return F.when(bp.isNotNull(), F.concat_ws(":", part[0], F.floor(bp / F.lit(WINDOW)).cast("string"))).otherwise(pos)


def subject_blocks(subjects: DataFrame, size: int, rows: int) -> DataFrame:
    """(DATASET, IID, BLOCK, PLACE): about ``size`` subjects and ``rows`` of their N_ROWS a block, dealt by a hash of the id."""
    counts = subjects.groupBy("DATASET").agg(F.count(F.lit(1)).alias("_n"), F.sum("N_ROWS").alias("_r"))
    counts = counts.select("DATASET", F.ceil(F.greatest(F.col("_n") / F.lit(size), F.col("_r") / F.lit(rows))).cast("long").alias("_blocks"))
    dealt = join_small(subjects, counts, ["DATASET"], "inner")
    dealt = dealt.select("DATASET", "IID", F.pmod(F.xxhash64("IID"), F.col("_blocks")).cast("int").alias("BLOCK"))
    place = F.row_number().over(Window.partitionBy("DATASET", "BLOCK").orderBy("IID")) - 1
    return dealt.withColumn("PLACE", place.cast("int"))


def event_times(table: DataFrame, fit: Fit) -> DataFrame:
    """(DATASET, GRIDS): the event times of each set of a cohort, once for all its rows."""
    time, event = fit.grid
    times = table.where((F.col(event) == 1) & F.col("OUTCOME").isNotNull()).select(*SET, time).distinct()
    times = times.groupBy(*SET).agg(F.sort_array(F.collect_set(F.col(time).cast("double"))).alias("GRID"))
    return times.groupBy("DATASET").agg(F.collect_list(F.struct("OUTCOME", "GRID")).alias("GRIDS"))


def packed_rows(table: DataFrame, placed: DataFrame, fit: Fit) -> DataFrame:
    """(DATASET, BLOCK, ROWS, GRIDS): the phenotype rows of a block in one value, by outcome, and the event times of the cohort's sets."""
    rows = table.join(placed, ["DATASET", "IID"])

    def pack(key: tuple, own: pa.Table) -> pa.Table:
        sets = {}
        outcome = np.array(own.column("OUTCOME").to_pylist(), object)
        values = np.column_stack([own.column(c).to_numpy(zero_copy_only=False).astype(float) for c in fit.columns])
        place = own.column("PLACE").to_numpy()
        for name in sorted(set(outcome)):
            at = np.flatnonzero(outcome == name)
            at = at[np.lexsort((*values[at].T, place[at]))]  # the same sums however rows arrive
            sets[name] = (place[at], values[at])
        return pa.table({"DATASET": [key[0].as_py()], "BLOCK": pa.array([key[1].as_py()], pa.int32()),
                         "ROWS": pa.array([pickle.dumps(sets)], pa.binary())})

    packed = rows.select(*SET, "BLOCK", "PLACE", *[F.col(c).cast("double").alias(c) for c in fit.columns]).groupBy(
        "DATASET", "BLOCK").applyInArrow(pack, "DATASET string, BLOCK int, ROWS binary")
    if fit.grid:
        return join_small(packed, event_times(table, fit), ["DATASET"], "left")
    return packed.withColumn("GRIDS", F.lit(None).cast("array<struct<OUTCOME: string, GRID: array<double>>>"))


def dealt_long(geno: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Long dosages by window and block, all batches there are, and the columns that name a variant."""
    observed = geno.where(F.col("DOSAGE").isNotNull()).join(placed, ["DATASET", "IID"])
    rows = observed.select("DATASET", window_of(F.col("POS")).alias("BATCH"), "BLOCK", *VARIANT_KEY, "PLACE",
                           F.col("DOSAGE").cast("double").alias("DOSAGE"))
    return rows, geno.select("DATASET", window_of(F.col("POS")).alias("BATCH")).distinct(), VARIANT_KEY


def dealt_arrays(geno: SubjectArrays, placed: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Slices of subject rows by batch and block."""
    def slices(array: Column) -> Column:
        count = F.ceil(F.size(array) / F.lit(TOGETHER)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(array, b * TOGETHER + 1, F.lit(TOGETHER)))
        return F.when(F.size(array) > 0, cut)

    joined = geno.rows.join(placed, ["DATASET", "IID"])
    rows = joined.select("DATASET", "BLOCK", "PLACE", F.posexplode(slices(F.col("DOSAGES"))).alias("BATCH", "DOSAGES"))
    rows = rows.withColumn("BATCH", F.col("BATCH").cast("string"))
    widths = geno.rows.groupBy("DATASET").agg(F.max(F.size("DOSAGES")).alias("_w")).where(F.col("_w") > 0)
    last = F.ceil(F.col("_w") / F.lit(TOGETHER)).cast("int") - 1
    batches = widths.select("DATASET", F.explode(F.transform(F.sequence(F.lit(0), last), lambda b: b.cast("string"))).alias("BATCH"))
    return rows, batches, ["J"]


def read_matrix(table: pa.Table, subjects: int, names: list[str]) -> tuple[list[tuple], np.ndarray]:
    """Variants of a dealt group and their (variants x subjects) matrix."""
    place = table.column("PLACE").to_numpy()
    if names == ["J"]:
        column = table.column("DOSAGES").combine_chunks()
        batch = int(table.column("BATCH")[0].as_py())
        lengths = column.value_lengths().to_numpy()
        matrix = np.full((int(lengths.max(initial=0)), subjects), np.nan)
        for i in range(0, len(lengths), READ_TOGETHER):
            some = lengths[i : i + READ_TOGETHER]
            row = np.repeat(place[i : i + READ_TOGETHER], some)
            at = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)
            matrix[at, row] = column.slice(i, READ_TOGETHER).flatten().to_numpy(zero_copy_only=False).astype(float)
        return [(batch * TOGETHER + i,) for i in range(len(matrix))], matrix
    keys = list(zip(*(table.column(c).to_pylist() for c in names)))
    order = {k: i for i, k in enumerate(sorted(set(keys), key=lambda k: tuple((x is None, x) for x in k)))}
    matrix = np.full((len(order), subjects), np.nan)
    matrix[[order[k] for k in keys], place] = table.column("DOSAGE").to_numpy()
    return list(order), matrix


def set_blocks(matrix: np.ndarray, sets: dict, grids: list[dict] | None):
    times = {g["OUTCOME"]: g["GRID"] for g in grids or []}
    for outcome, (place, columns) in sets.items():
        yield outcome, Block(matrix, place, columns, np.array(times.get(outcome, []), float))


def pieces(variants: int):
    return [slice(i, min(i + TOGETHER, variants)) for i in range(0, variants, TOGETHER)]


def added(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] for k in a}


def summed(fit: Fit, state: dict, block: Block) -> dict[str, np.ndarray]:
    """``fit.part`` of a block, whose rows come by subject, in runs of whole subjects: the work space does not grow with the rows."""
    place, total, i = block.place, None, 0
    while total is None or i < len(place):
        j = min(i + ROWS_TOGETHER, len(place))
        if j < len(place):  # a subject longer than a run is not parted
            j = int(np.searchsorted(place, place[j])) if place[j] != place[i] else int(np.searchsorted(place, place[j], "right"))
        part = fit.part(state, Block(block.dosages, place[i:j], block.columns[i:j], block.grid))
        total, i = part if total is None else added(total, part), j
    return total


def array_scan(geno: DataFrame | SubjectArrays, table: DataFrame, fit: Fit) -> DataFrame:
    """Fit every variant of ``geno`` for every set of ``table`` (DATASET, OUTCOME, IID, columns...).

    Long genotypes have rows (DATASET, POS, A1, A2, IID, DOSAGE).  A variant
    without any observed row in a set has no result there.
    """
    table = checkpointed(table.select(*SET, "IID", *fit.columns))
    subjects = table.groupBy("DATASET", "IID").agg(F.count(F.lit(1)).alias("N_ROWS"))
    placed = checkpointed(subject_blocks(subjects, BLOCK_SUBJECTS, BLOCK_ROWS))
    rows = checkpointed(packed_rows(table, placed, fit))
    arrays = isinstance(geno, SubjectArrays)
    dealt, batches, names = dealt_arrays(geno, placed) if arrays else dealt_long(geno, placed)
    cohorts = placed.groupBy("DATASET").agg(F.max("BLOCK").alias("_last"))
    sizes = placed.groupBy("DATASET", "BLOCK").agg(F.count(F.lit(1)).cast("int").alias("SUBJECTS"))
    sent = batches.join(rows.join(sizes, ["DATASET", "BLOCK"]), "DATASET")
    sent = sent.select(*[F.col(c).alias(c) for c in sent.columns])  # columns of its own, apart from those of the dosages
    types = {"J": "long"} if arrays else {f.name: f.dataType.simpleString() for f in geno.schema.fields}
    keys = ["DATASET", "OUTCOME", *names]
    schema = ", ".join(f"{k} {types.get(k, 'string')}" for k in keys) + ", " + fit.outputs
    many = cohorts.where(F.col("_last") > 0).select("DATASET")
    if many.isEmpty():
        out = in_one_task(dealt, sent, fit, names, schema)
    else:
        few = cohorts.where(F.col("_last") == 0).select("DATASET")

        def only(df: DataFrame, some: DataFrame) -> DataFrame:
            return df.join(some, "DATASET", "left_semi")

        out = in_one_task(only(dealt, few), only(sent, few), fit, names, schema).unionByName(
            across_blocks(only(dealt, many), only(sent, many), fit, names, schema))
    if not arrays:
        return out
    named = join_small(out, geno.variants, ["J"], "inner").drop("J")
    return named.select(*SCAN_KEY, *[c for c in named.columns if c not in SCAN_KEY])


def result_table(found: list[tuple], schema: pa.Schema) -> pa.Table:
    """Rows of (dataset, outcome, variants, outputs) without the variants that have no observation."""
    parts = []
    for dataset, outcome, variants, outputs in found:
        kept = np.flatnonzero(np.asarray(outputs["N_OBS"]) > 0)
        columns = [[dataset] * len(kept), [outcome] * len(kept), *([variants[i][k] for i in kept] for k in range(len(variants[0])))]
        columns += [np.asarray(outputs[n])[kept] for n in schema.names[len(columns):]]
        parts.append(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
    return pa.concat_tables(parts) if parts else schema.empty_table()


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def in_one_task(dealt: DataFrame, sent: DataFrame, fit: Fit, names: list[str], schema: str) -> DataFrame:
    """All steps of a batch in the task that holds its only block."""
    own = arrow_schema(schema)

    def meet(key: tuple, dosages: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(dosages) or not len(rows):
            return own.empty_table()
        variants, matrix = read_matrix(dosages, rows.column("SUBJECTS")[0].as_py(), names)
        found = []
        for outcome, block in set_blocks(matrix, pickle.loads(rows.column("ROWS")[0].as_py()), rows.column("GRIDS")[0].as_py()):
            for cut in pieces(len(variants)):
                part = Block(matrix[cut], block.place, block.columns, block.grid)
                state = fit.start(len(part.dosages))
                while not state["finished"]:
                    state = fit.advance(state, summed(fit, state, part))
                found.append((key[0].as_py(), outcome, variants[cut], fit.output(state)))
        return result_table(found, own)

    group = ["DATASET", "BATCH"]
    return dealt.groupBy(*group).cogroup(sent.groupBy(*group)).applyInArrow(meet, schema)


STATES = "DATASET string, BATCH string, OUTCOME string, PIECE int, STATE binary, FINISHED boolean"


def across_blocks(dealt: DataFrame, sent: DataFrame, fit: Fit, names: list[str], schema: str, most_steps: int = 200) -> DataFrame:
    """The same fit where a cohort has several blocks: one aggregation over blocks for each step."""
    spark, own = dealt.sparkSession, arrow_schema(schema)
    group = ["DATASET", "BATCH", "BLOCK"]
    # All blocks of a batch name the same variants, whichever of them its own rows hold.
    listed = dealt.groupBy("DATASET", "BATCH").agg(F.sort_array(F.collect_set(F.struct(*names))).alias("NAMES")) if names != ["J"] else None
    if listed is not None:
        sent = sent.join(listed, ["DATASET", "BATCH"])

    def pack(key: tuple, dosages: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"DATASET": [], "BATCH": [], "BLOCK": [], "PACKED": []}
        if len(rows) and len(dosages):
            subjects = rows.column("SUBJECTS")[0].as_py()
            variants, matrix = read_matrix(dosages, subjects, names)
            if names != ["J"]:
                every = [tuple(x[n] for n in names) for x in rows.column("NAMES")[0].as_py()]
                full = np.full((len(every), subjects), np.nan)
                full[[every.index(v) for v in variants]] = matrix
                variants, matrix = every, full
            packed = pickle.dumps((variants, matrix, pickle.loads(rows.column("ROWS")[0].as_py()), rows.column("GRIDS")[0].as_py()))
            out = {"DATASET": [key[0].as_py()], "BATCH": [key[1].as_py()], "BLOCK": [key[2].as_py()], "PACKED": [packed]}
        return pa.table(out, schema=pa.schema([("DATASET", pa.string()), ("BATCH", pa.string()), ("BLOCK", pa.int32()), ("PACKED", pa.binary())]))

    def first(batches):
        for b in batches:
            for row in b.to_pylist():
                variants, *held = pickle.loads(row["PACKED"])
                for outcome, block in set_blocks(*held):
                    for i, cut in enumerate(pieces(len(variants))):
                        part = Block(block.dosages[cut], block.place, block.columns, block.grid)
                        yield part_row(row, outcome, i, variants[cut], fit.start(len(part.dosages)), part)

    def later(batches):
        for b in batches:
            for row in b.to_pylist():
                variants, *held = pickle.loads(row["PACKED"])
                blocks = dict(set_blocks(*held))
                for s in row["STATES"]:
                    if s["OUTCOME"] in blocks:
                        block, cut = blocks[s["OUTCOME"]], pieces(len(variants))[s["PIECE"]]
                        part = Block(block.dosages[cut], block.place, block.columns, block.grid)
                        yield part_row(row, s["OUTCOME"], s["PIECE"], variants[cut], pickle.loads(s["STATE"])[1], part)

    def part_row(row, outcome, piece, variants, state, block):
        value = pickle.dumps((variants, state, summed(fit, state, block)))
        return pa.RecordBatch.from_arrays(
            [pa.array([row["DATASET"]]), pa.array([row["BATCH"]]), pa.array([outcome]), pa.array([piece], pa.int32()),
             pa.array([row["BLOCK"]], pa.int32()), pa.array([value], pa.binary())],
            ["DATASET", "BATCH", "OUTCOME", "PIECE", "BLOCK", "PART"])

    def moved(batches):
        """Adds the parts of a set one after the other, in the order of blocks."""
        key = total = None

        def done():
            variants, state, sums = total
            state = fit.advance(state, sums)
            return pa.RecordBatch.from_arrays(
                [*(pa.array([k]) for k in key[:3]), pa.array([key[3]], pa.int32()),
                 pa.array([pickle.dumps((variants, state))], pa.binary()), pa.array([bool(state["finished"])])],
                ["DATASET", "BATCH", "OUTCOME", "PIECE", "STATE", "FINISHED"])

        for b in batches:
            for row in b.to_pylist():
                here = (row["DATASET"], row["BATCH"], row["OUTCOME"], row["PIECE"])
                variants, state, sums = pickle.loads(row["PART"])
                if here != key:
                    if key is not None:
                        yield done()
                    key, total = here, (variants, state, sums)
                else:
                    total = (variants, state, added(total[2], sums))
        if key is not None:
            yield done()

    parts_type = "DATASET string, BATCH string, OUTCOME string, PIECE int, BLOCK int, PART binary"
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = dealt.groupBy(*group).cogroup(sent.groupBy(*group)).applyInArrow(pack, "DATASET string, BATCH string, BLOCK int, PACKED binary")
    packed = checkpointed(packed)
    blocks = packed.select(*group)
    packed = packed.repartition(places, *group).persist(StorageLevel.DISK_ONLY)
    finished, step_of = None, ["DATASET", "BATCH", "OUTCOME", "PIECE"]
    try:
        with small_batches(spark):  # packed blocks are large
            parts = packed.mapInArrow(first, parts_type)
            for _ in range(most_steps):
                sums = parts.repartition(places, *step_of).sortWithinPartitions(*step_of, "BLOCK")
                states = checkpointed(sums.mapInArrow(moved, STATES))
                done = states.where("FINISHED")
                finished = done if finished is None else finished.unionByName(done)
                left = states.where("NOT FINISHED")
                if left.isEmpty():
                    break
                waiting = left.groupBy("DATASET", "BATCH").agg(F.collect_list(F.struct("OUTCOME", "PIECE", "STATE")).alias("STATES"))
                sent_on = blocks.join(waiting, ["DATASET", "BATCH"])  # a state goes to each block, the blocks stay where they are
                parts = packed.join(sent_on.hint("shuffle_hash"), group).mapInArrow(later, parts_type)
    finally:
        packed.unpersist()

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                variants, state = pickle.loads(row["STATE"])
                table = result_table([(row["DATASET"], row["OUTCOME"], variants, fit.output(state))], own)
                yield from table.to_batches()

    return finished.mapInArrow(read, schema)


def weighted_sums(w: np.ndarray, s: np.ndarray, x: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Matrices of sum(w a b) per variant over [first columns of x..., s, ...] ordered as (x, s)."""
    v, q = len(w), x.shape[1]
    out = np.empty((v, q + 1, q + 1))
    out[:, :q, :q] = (w @ products).reshape(v, q, q)
    ws = w * s
    out[:, :q, q] = out[:, q, :q] = ws @ x
    out[:, q, q] = (ws * s).sum(axis=1)
    return out
