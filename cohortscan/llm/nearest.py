"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, several times over, each time with
other directions and another shift, and ordered along a Hilbert curve.  Spark
sorts each ordering by ranges; a query meets the rows within a window of ranks
around its own place, and the exact inner products of all that it met are
ranked.  One more coordinate makes the largest inner product the least
distance.

Projections are fitted on a bounded sample of vectors.  The window is the one
at which a bounded sample of queries, held against all rows, finds the target
recall; every row is in every ordering.  Without structure in the vectors the
window covers much of the table, and the work grows accordingly.

Null vectors, zero vectors and vectors with null or non-finite components take
no part, nor do vectors of another length than the most frequent one (the
shorter of two).  Rows that repeat a vec_id count once, with the least vector.
Ties go to the smaller vec_id.  An empty table has no neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.llm.common import bounded_sample, pick
from cohortscan.session import checkpointed

CURVES = 4
DIMS = 4
BITS = 8
#: Vectors that the projections are fitted on, and queries that the window is measured on.
FIT_ROWS = 4096
MEASURED = 100
RECALL = 0.96
#: Lists of neighbours that are merged in one row.
FAN = 64
#: Rows of an ordering that one task compares with the queries around them.
BLOCK = 4096
QUERIES = 2048


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of whole-number points (a row each, ``bits`` bits a coordinate).

    Undoes the turns of the curve from the coarsest bit to the finest, then
    reads the bits of all coordinates as one Gray-coded number.
    """
    x = x.T.astype(np.uint64).copy()
    n = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(n):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        carry ^= np.where((x[n - 1] >> np.uint64(level)) & one != 0, (one << np.uint64(level)) - one, np.uint64(0))
    x ^= carry
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(level)) & one)
    return out.astype(np.int64)


@dataclass
class Curves:
    """Directions (curve, dimension, component), grid edges and shift of each ordering."""

    norm: float
    directions: np.ndarray
    edges: np.ndarray
    shifts: np.ndarray

    def places(self, vectors: np.ndarray, as_query: bool = False) -> np.ndarray:
        """Place of each vector (row) on each curve (column)."""
        own = lifted(vectors, self.norm, as_query)
        out = np.empty((len(own), len(self.directions)), np.int64)
        for c, directions in enumerate(self.directions):
            p = own @ directions.T
            u = np.stack([np.searchsorted(e, p[:, d]) / (len(e) + 1) for d, e in enumerate(self.edges[c])], 1)
            out[:, c] = hilbert(((u + self.shifts[c]) / 2 * (1 << BITS)).astype(np.int64), BITS)
        return out


def lifted(vectors: np.ndarray, norm: float, as_query: bool) -> np.ndarray:
    """One more coordinate: all rows on one sphere, queries in the plane of the original vectors."""
    square = (vectors**2).sum(1)
    if as_query:
        return np.column_stack((vectors * (norm / np.sqrt(square))[:, None], np.zeros(len(vectors))))
    return np.column_stack((vectors, np.sqrt(np.maximum(norm**2 - square, 0))))


def fit(vectors: np.ndarray, norm: float, curves: int = CURVES) -> Curves:
    """Random orthogonal directions, led by the principal ones, and their quantiles."""
    own = lifted(vectors, norm, False)
    rng = np.random.default_rng(17)
    _, spread, axes = np.linalg.svd(own - own.mean(0), full_matrices=False)
    weight = spread / max(spread.max(), 1e-300)
    directions = []
    for _ in range(curves):
        mixed = rng.normal(size=(DIMS, len(axes))) * weight
        directions.append((mixed @ axes))
    directions = np.array(directions)
    grid = np.arange(1, 1 << BITS) / (1 << BITS)
    edges = np.array([[np.quantile(own @ d, grid) for d in ds] for ds in directions])
    return Curves(norm, directions, edges, np.arange(curves) / curves)


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the vectors that are compared."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & sound & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (usual["n"] if usual else 0))
    return checkpointed(rows.groupBy("vec_id").agg(F.min("v").alias("v")))


def stacked(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def best(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ``k`` largest inner products of each query with the rows but its own, ties to the smaller id."""
    rough = q @ x.T
    out = []
    for row, own, vector in zip(rough, q_ids, q):
        row[ids == own] = -np.inf
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            at = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)))
        else:
            at = np.flatnonzero(row > -np.inf)
        score = (x[at] * vector).sum(1)  # the same sum wherever a pair meets
        order = np.lexsort((ids[at], -score))[:k]
        order = order[ids[at[order]] != own]
        out.append((ids[at[order]], score[order]))
    return out


_FOUND = "query_id long, found array<struct<less:double,vec_id:long>>"


def _found(q_ids, results) -> pd.DataFrame:
    lists = [[{"less": -float(s), "vec_id": int(i)} for i, s in zip(*r)] for r in results]
    return pd.DataFrame({"query_id": pd.Series(q_ids, dtype="int64"), "found": pd.Series(lists, dtype=object)})


def merged(found: DataFrame, k: int, parts: int) -> DataFrame:
    """One row for each query with its ``k`` nearest of all lists (query_id, part, found).

    ``part`` is from 0 to below ``parts``.  Lists of up to FAN parts are merged
    at once, in as many rounds as that takes, so no row holds more than these.
    """
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))))
    while parts > FAN:
        found = found.groupBy("query_id", F.floor(F.col("part") / FAN).alias("part")).agg(F.slice(every, 1, k).alias("found"))
        parts = -(-parts // FAN)
    return found.groupBy("query_id").agg(F.slice(every, 1, k).alias("found"))


def exact(rows: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """Brute force: a bounded number of ``queries`` (vec_id, v) against all ``rows``."""
    held = rows.sparkSession.sparkContext.broadcast((queries["vec_id"].to_numpy(), stacked(queries["v"])))

    def run(batches):
        ids, q = held.value
        for b in batches:
            if len(b):
                yield _found(ids, best(b["vec_id"].to_numpy(), stacked(b["v"]), ids, q, k))

    # A list for each batch of a partition; ``rows`` are checkpointed, so their partitions are known.
    lists = rows.mapInPandas(run, _FOUND).withColumn("part", F.spark_partition_id().cast("long"))
    return merged(lists, k, rows.rdd.getNumPartitions())


def ordered(rows: DataFrame, curves: Curves) -> DataFrame:
    """vec_id, v, curve and rank (from 0) of every row on every curve."""
    held = rows.sparkSession.sparkContext.broadcast(curves)

    def run(batches):
        for b in batches:
            if len(b):
                yield b.assign(places=list(held.value.places(stacked(b["v"]))))

    placed = rows.mapInPandas(run, "vec_id long, v array<double>, places array<long>")
    placed = placed.select("vec_id", "v", F.posexplode("places").alias("curve", "place"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["curve", "place", "vec_id"]
    placed = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = checkpointed(placed.select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    # Two numbers for each partition and curve.
    counts = placed.groupBy("curve", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    offsets, total = [], {}
    for r in sorted(counts, key=lambda r: (r["curve"], r["part"])):
        offsets.append((r["curve"], r["part"], total.get(r["curve"], 0) - r["first"]))
        total[r["curve"]] = total.get(r["curve"], 0) + r["n"]
    shift = rows.sparkSession.createDataFrame(offsets, "curve int, part int, shift long")
    return placed.join(F.broadcast(shift), ["curve", "part"]).select(
        "vec_id", "v", "curve", (F.col("at") + F.col("shift")).alias("rank"))


def window(ranks: DataFrame, rows: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
    """Half width in ranks at which a sample of queries meets ``recall`` of its true neighbours on some curve."""
    sample = bounded_sample(queries, ["vec_id"], MEASURED).toPandas()
    true = exact(rows, sample, k).select("query_id", F.explode("found.vec_id").alias("vec_id"))
    true = checkpointed(true)
    place = ranks.select("vec_id", "curve", "rank")
    pairs = true.join(place, "vec_id").join(
        place.select(F.col("vec_id").alias("query_id"), "curve", F.col("rank").alias("own")), ["query_id", "curve"])
    apart = pairs.groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("d"))
    got = apart.select(F.percentile("d", recall)).first()[0]  # MEASURED times k rows
    return int(np.ceil(got or 0)) + 1


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for the ids divisible by ``every``."""
    spark = vectors.sparkSession
    rows = taking_part(vectors)
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square"),
    ).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if facts["n"] < 2 or not facts["asked"]:
        return spark.createDataFrame([], empty)
    sample = bounded_sample(rows, ["vec_id"], FIT_ROWS).toPandas()
    curves = fit(stacked(sample["v"]), float(np.sqrt(facts["square"])))
    ranks = checkpointed(ordered(rows, curves))
    asked = F.col("vec_id") % every == 0
    half = window(ranks, rows, rows.where(asked), k, recall)

    # Every query goes to the blocks that its window touches; many queries at a block are dealt over salts.
    last = (facts["n"] - 1) // BLOCK
    salts = int(np.ceil((BLOCK + 2 * half) * facts["asked"] / facts["n"] / QUERIES))
    first = F.greatest(F.floor((F.col("rank") - half) / BLOCK), F.lit(0))
    final = F.least(F.floor((F.col("rank") + half) / BLOCK), F.lit(last))
    queries = ranks.where(asked).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "curve", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt"),
        F.explode(F.sequence(first, final)).alias("block"))
    blocks = ranks.select(
        "vec_id", "v", "curve", F.floor(F.col("rank") / BLOCK).alias("block"),
        F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"))

    # The blocks of one window follow each other, so their remainders by the most there can be differ.
    most = 2 * half // BLOCK + 2

    def meet(block, query):
        if not len(block) or not len(query):
            return _found([], []).assign(part=pd.Series([], dtype="int64"))
        q_ids = query["query_id"].to_numpy()
        met = best(block["vec_id"].to_numpy(), stacked(block["v"]), q_ids, stacked(query["q"]), k)
        return _found(q_ids, met).assign(part=int(block["curve"].iloc[0]) * most + int(block["block"].iloc[0]) % most)

    key = ["curve", "block", "salt"]
    found = blocks.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(meet, _FOUND + ", part long")
    return merged(found, k, CURVES * most).select("query_id", F.posexplode("found").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
