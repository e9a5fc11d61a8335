"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources.  They are counted by membership
pattern; the words of a pattern flow to the sources in it, at no cost the
first time and at growing cost for every repetition, so that the total of the
convex costs is least.  The quotas that come out are then filled with whole
documents in an order that a seed fixes: every document of a pattern is taken
the same number of times, or once more if its place in that order lies within
the rest of the quota; one further document closes the gap that is left.

A null text has no words; documents without words are taken 0 times.  A null
source is a source of its own and comes last.  A row's place follows from its
id and text, so null ids take part like any other, each text with a place of
its own; rows that repeat both have the same place and are taken alike.  An
empty table mixes to an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscan.llm.common import pick, row_key
from cohortscan.session import checkpointed

#: Share of the words of all documents that the mix takes, repetitions counted.
BUDGET = 1.5
SEED = 11
WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 2
#: First cut of the seeded order; within the bucket where a quota ends documents are ordered one by one.
BUCKETS = 1 << 14
#: The flow is solved on the driver; a corpus has far fewer combinations of sources than documents.
MAX_PATTERNS = 100_000


def words_in(text: Column) -> Column:
    """Runs of anything but the six ASCII white spaces; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float = BUDGET, most: float = REPEATS) -> list[float]:
    """Words wanted of each source: ``budget`` times all words dealt by weight, no source above ``most`` times its own.

    What exceeds a source's limit is dealt again by weight among the others.
    """
    left, out = budget * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes))]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


@dataclass
class Arc:
    to: int
    room: float
    cost: float
    back: int


class Network:
    """Min-cost flow by shortest augmenting paths with potentials."""

    def __init__(self, nodes: int):
        self.arcs: list[list[Arc]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: float, cost: float) -> Arc:
        arc = Arc(b, room, cost, len(self.arcs[b]))
        self.arcs[a].append(arc)
        self.arcs[b].append(Arc(a, 0.0, -cost, len(self.arcs[a]) - 1))
        return arc

    def flow(self, source: int, sink: int, least: float = 1e-6) -> None:
        height = [0.0] * len(self.arcs)
        while True:
            far = [float("inf")] * len(self.arcs)
            via: list[tuple[int, Arc] | None] = [None] * len(self.arcs)
            far[source] = 0.0
            waiting = [(0.0, source)]
            while waiting:
                d, a = heapq.heappop(waiting)
                if d > far[a]:
                    continue
                for arc in self.arcs[a]:
                    if arc.room > least:
                        length = d + arc.cost + height[a] - height[arc.to]
                        if length < far[arc.to] - 1e-12:
                            far[arc.to], via[arc.to] = length, (a, arc)
                            heapq.heappush(waiting, (length, arc.to))
            if via[sink] is None:
                return
            height = [h + min(f, far[sink]) for h, f in zip(height, far)]
            path, at = [], sink
            while at != source:
                a, arc = via[at]
                path.append(arc)
                at = a
            amount = min(arc.room for arc in path)
            for arc in path:
                arc.room -= amount
                self.arcs[arc.to][arc.back].room += amount


def quotas(
    patterns: Sequence[tuple[frozenset, int]], wanted: dict, repeats: int = REPEATS
) -> dict[frozenset, dict[object, float]]:
    """Words of each pattern (its sources, its words) routed to each source.

    Repetition ``r`` of a word costs ``r``, so words are repeated only where a
    target cannot be reached otherwise, and repetitions are spread evenly.
    """
    names = sorted(wanted, key=lambda s: (s is None, s if s is not None else ""))
    place = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    sink = 1 + len(patterns) + len(names)
    net = Network(sink + 1)
    routes: dict[tuple[int, object], Arc] = {}
    for i, (members, size) in enumerate(patterns, 1):
        for r in range(repeats):
            net.add(0, i, float(size), float(r))
        for s in members:
            routes[i, s] = net.add(i, place[s], float(repeats * size), 0.0)
    for s in names:
        net.add(place[s], sink, float(wanted[s]), 0.0)
    net.flow(0, sink)
    out: dict[frozenset, dict[object, float]] = {}
    for (i, s), arc in routes.items():
        members, size = patterns[i - 1]
        out.setdefault(members, {})[s] = repeats * size - arc.room
    return out


def pattern_of(members: Column) -> Column:
    """Text that stands for a set of sources (array of strings, null allowed)."""
    named = F.transform(F.array_sort(F.array_distinct(members)), lambda s: F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), s)))
    return F.array_join(named, "\x00")


def members_of(pattern: str) -> list[str | None]:
    return [None if p == "-" else p[1:] for p in pattern.split("\x00")]


def place_of(seed: int) -> Column:
    """Place of a row (doc_id, text) in the seeded order."""
    return F.pmod(F.xxhash64(F.lit(seed), row_key(F.col("doc_id"), F.col("text"))), F.lit(2**52))


def taken(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` (pattern, place, size, ...) with ``copies``, the number of times each is taken.

    ``rates`` (pattern, quota) says how many words each pattern gives.  Only
    sums by pattern and bucket of places are gathered; the one bucket in which
    the rest of a quota ends is ordered document by document.
    """
    bucket = F.col("place") % BUCKETS
    upto = "sum(words) OVER (PARTITION BY pattern ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    sums = rows.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    whole = sums.groupBy("pattern").agg(F.sum("words").alias("all")).join(rates, "pattern")
    full = F.when(F.col("all") > 0, F.floor(F.col("quota") / F.col("all"))).otherwise(F.lit(0))
    whole = whole.withColumn("full", full).withColumn("rest", F.col("quota") - F.col("full") * F.col("all"))
    # A pattern has BUCKETS sums at most, whatever the number of documents.
    cut = sums.withColumn("upto", F.expr(upto.format("bucket"))).join(whole, "pattern").groupBy("pattern").agg(
        F.first("full").alias("full"), F.first("rest").alias("rest"),
        F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("bucket", "upto"))).alias("under"),
        F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))).alias("open"),
    )
    cut = cut.select(
        "pattern", "full", F.coalesce("under.bucket", F.lit(-1)).alias("closed"),
        (F.col("rest") - F.coalesce("under.upto", F.lit(0))).alias("more"),
        F.coalesce("open", F.lit(BUCKETS)).alias("open"),
    )
    # One row of numbers for each of at most MAX_PATTERNS patterns: it is sent to the rows, as one may hold most of them.
    cut = checkpointed(cut)
    edge = rows.select("pattern", "place", "size").join(F.broadcast(cut), "pattern").where(bucket == F.col("open"))
    edge = edge.groupBy("pattern", "place").agg(F.sum("size").alias("words"), F.first("more").alias("more"))
    edge = edge.withColumn("upto", F.expr(upto.format("place")))
    last = edge.where(F.col("upto") <= F.col("more")).groupBy("pattern").agg(F.max(F.struct("place", "upto")).alias("last"))
    cut = cut.join(last, "pattern", "left").withColumn("last_place", F.coalesce("last.place", F.lit(-1)))
    cut = cut.withColumn("gap", F.col("more") - F.coalesce("last.upto", F.lit(0)))
    within = (bucket <= F.col("closed")) | ((bucket == F.col("open")) & (F.col("place") <= F.col("last_place")))
    # What is still missing is filled by the one document whose size comes nearest to it.
    rest = rows.select("pattern", "place", "size").join(F.broadcast(cut), "pattern").where(~within)
    rest = rest.groupBy("pattern", "place").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    off = F.abs(F.col("words") - F.col("gap"))
    extra = rest.where(off < F.col("gap")).groupBy("pattern").agg(F.min_by("place", F.struct(off, "place")).alias("extra"))
    cut = cut.join(extra, "pattern", "left")
    within = within | F.coalesce(F.col("place") == F.col("extra"), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("full") + within.cast("long")).otherwise(F.lit(0)).cast("long")
    kept = [F.col(c) for c in rows.columns]
    return rows.join(F.broadcast(cut), "pattern").select(*kept, copies.alias("copies"))


@dataclass
class Mix:
    """Rows of documents with pattern, size and copies; sizes and targets by source."""

    rows: DataFrame
    sizes: dict
    wanted: dict


def mix(
    documents: DataFrame, members: Column, keep: Sequence[str] = (), weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET, repeats: int = REPEATS, seed: int = SEED,
) -> Mix:
    """Take whole documents (doc_id, text, ...) so that each source comes near its target.

    Sources in code point order, null last, get ``weights`` in turn.
    """
    rows = checkpointed(documents.select(
        "doc_id", *keep, pattern_of(members).alias("pattern"), words_in(F.col("text")).alias("size"),
        place_of(seed).alias("place"),
    ))
    totals = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"documents have more than {MAX_PATTERNS} membership patterns")
    patterns = [(frozenset(members_of(r["pattern"])), r["size"]) for r in sorted(totals, key=lambda r: r["pattern"])]
    names = sorted({s for m, _ in patterns for s in m}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for m, n in patterns if s in m) for s in names}
    share = [weights[i % len(weights)] for i in range(len(names))]
    wanted = dict(zip(names, targets([sizes[s] for s in names], share, budget, repeats)))
    # Overlapping sources count a word once in what is dealt out.
    routed = quotas(patterns, wanted, repeats)
    rates = [(r["pattern"], float(sum(routed[frozenset(members_of(r["pattern"]))].values()))) for r in totals]
    spark = documents.sparkSession
    mixed = taken(rows, spark.createDataFrame(rates, "pattern string, quota double"))
    return Mix(mixed, sizes, wanted)


def mixed_sources(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repetitions counted) of every document."""
    documents = pick(documents, "doc_id", "text", "source")
    own = F.col("source").cast("string")
    done = mix(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own.alias("source")), F.array("source"))
    by_pattern = [("-" if s is None else "+" + s, done.sizes[s], done.wanted[s]) for s in done.sizes]
    goals = documents.sparkSession.createDataFrame(by_pattern, "pattern string, source_size long, target double")
    return done.rows.join(F.broadcast(goals), "pattern").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_corpus(documents: DataFrame) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it."""
    names = ("doc_id", "text", "lang", "source", "n_chars")
    documents = pick(documents, *names)
    done = mix(documents, F.array(F.col("source").cast("string")))
    # Rows that repeat a document share place, and so copies, unless their sources differ.
    copies = done.rows.groupBy("place", "pattern", "size").agg(F.first("copies").alias("copies"))
    key = documents.withColumn("pattern", pattern_of(F.array(F.col("source").cast("string"))))
    key = key.withColumn("size", words_in(F.col("text"))).withColumn("place", place_of(SEED))
    out = key.join(copies.where("copies > 0"), ["place", "pattern", "size"])
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*names)
