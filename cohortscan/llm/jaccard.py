"""N-gram Jaccard join by a MinHash LSH forest.

A text is the set of its five-word shingles (lower-cased runs of letters and
digits; a shorter text is one shingle).  Texts with equal sets are one class
from the start.  Each tree of the forest is a sorted prefix trie: a signature
of ``DEPTH`` MinHash values, first value in the highest bits of a long, so that
the order of the longs is the order of the trie and neighbours in it share the
longest prefixes.  Texts that share a whole signature in some tree are compared
first; then the matched prefix is shortened value by value until the recall
that the links found so far imply reaches the target.

A link of similarity j is found at depth d with a probability p that is known,
so each one found stands for 1 / p links.  One link at the threshold is added
that stands for those not seen, so few links never pass for proof.  The
shortest prefix is the one at which all links at the threshold meet with the
target recall, whatever the data hold.

Pairs that meet are verified exactly, in blocks of bounded size, at the first
depth and in the first tree that holds them; a block returns counts and local
classes, not pairs.  Large buckets of the shortest prefix that have sets in
common are one crowd, if all its pairs are no more than those of its buckets:
its sets are compared with each other once, and no tree brings them together
again.  Links inside crowds do not count for the recall, as none of them is
left unseen.

Null and empty texts, and texts without words, have no shingles: they are
linked with nothing and are a class each.  Rows that repeat a document count
as documents of their own.  Very common words or passages make no pair
candidates by themselves.

Rows are told apart by a key of id and text, not by the id.  A row with a null
id links like any other; the id of a class is the least that is not null, and
null for a class of null ids only.  Two texts under one id are two documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscan.llm.common import pick, row_key, small_batches
from cohortscan.session import checkpointed

WORDS = 5
#: Least similarity, as a fraction so that the test is exact.
THRESHOLD = (4, 5)
TREES = 24
#: MinHash values of a full signature, and the bits kept of each.
DEPTH = 6
BITS = 10
RECALL = 0.99999
#: Members of a bucket that are compared with each other in one go.
CHUNK = 256
#: Prefixes that part a bucket, at most.
PARTING = 12
#: Members of blocks in a partition, on average.
MEMBERS = 20_000
_WORD = re.compile(r"[^\W_]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each text, end to end, and how many each has."""
    words = [_WORD.findall((t or "").lower()) for t in texts]
    flat = [w for ws in words for w in ws]
    if not flat:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    hashed = pd.util.hash_array(np.array(flat, object))
    parts, stop = [], 0
    for ws in words:
        h = hashed[stop: stop + len(ws)]
        stop += len(ws)
        n = min(WORDS, len(h))
        s = np.zeros(max(len(h) - n + 1, 0) if n else 0, np.uint64)
        for i in range(n):
            s = _mix(s + h[i: len(h) - n + 1 + i] + np.uint64(i + n))
        parts.append(np.unique(s))
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def prefix_depth(trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Longest prefix at which a pair at the threshold meets in some tree with the target recall."""
    for d in range(depth, 0, -1):
        if 1 - missed(THRESHOLD[0] / THRESHOLD[1], d, trees) >= recall:
            return d
    raise ValueError("more trees are needed for this recall")


def missed(similarity, depth, trees: int = TREES):
    """Probability that a pair shares no prefix of this depth in any tree."""
    return (1 - similarity**depth) ** trees


def unseen(similarity: np.ndarray) -> np.ndarray:
    """Links that each found link stands for beside itself, at each depth from 1 (columns)."""
    lost = missed(np.asarray(similarity, float)[:, None], np.arange(1, DEPTH + 1))
    return lost / (1 - lost)


def recall_of(told: np.ndarray, depth: int) -> float:
    """Share of links found down to this depth, from what the links found stand for."""
    return told[0] / (told[0] + told[depth])


def signature_keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Signature of each set of shingles (row) in each tree (column); rows without shingles stay 0."""
    out = np.zeros((len(sizes), TREES), np.uint64)
    has = np.flatnonzero(sizes)
    if not len(has):
        return out
    starts = (np.cumsum(sizes) - sizes)[has]
    rng = np.random.default_rng(2024)
    odd = rng.integers(1 << 62, size=(TREES, DEPTH), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for t in range(TREES):
        key = np.zeros(len(has), np.uint64)
        for d in range(DEPTH):
            h = flat * odd[t, d]
            least = _mix(np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts))
            key = (key << np.uint64(BITS)) | (least >> np.uint64(64 - BITS))
        out[has, t] = key
    return out


def cut_bits(depth: int) -> int:
    """Bits of a signature after the prefix of this depth."""
    return BITS * (DEPTH - depth)


def identity(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two sums that stand for a set of shingles, whatever their order."""
    ends, out = np.cumsum(sizes), []
    for h in (_mix(flat), _mix(flat * np.uint64(3) + np.uint64(7))):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
        out.append((total[ends] - total[ends - sizes]).view(np.int64))
    return out


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, row_key, s0, s1, n (identity and size of the shingle set) and keys (a signature for each tree)."""
    def run(batches):
        for b in batches:
            flat, sizes = shingles(b.column("text").to_pylist())
            s0, s1 = identity(flat, sizes)
            keys = signature_keys(flat, sizes)
            at = pa.array(np.arange(0, keys.size + 1, TREES), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row_key"), pa.array(s0), pa.array(s1), pa.array(sizes),
                 pa.ListArray.from_arrays(at, pa.array(keys.ravel().view(np.int64)))],
                ["doc_id", "row_key", "s0", "s1", "n", "keys"],
            )

    return documents.mapInArrow(run, "doc_id long, row_key long, s0 long, s1 long, n long, keys array<long>")


def verified(rows: Iterator[tuple], group_of, depth: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(node, links, root, unseen) from rows in order of their group."""
    held, at = [], None
    for row in rows:
        g = group_of(row)
        if g != at and held:
            yield from compare(at, held, depth)
            held = []
        at = g
        held.append(row)
    if held:
        yield from compare(at, held, depth)


def compare(group: tuple, rows: list[tuple], depth: int) -> list[tuple[int, int, int, np.ndarray]]:
    """Exact links within a chunk, or between two chunks, that no deeper prefix, no earlier tree and no crowd has met.

    The last item is, with the left end of each link, the number of links it
    stands for beside itself at each depth, first of all the link itself.
    """
    tree, _, a, b = group
    chunk = np.array([r[0] for r in rows])
    node = np.array([r[1] for r in rows], np.int64)
    weight = np.array([r[2] for r in rows], np.int64)
    keys = np.stack([r[3] for r in rows])
    left, right = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
    new = np.ones((len(left), len(right)), bool)
    same, deeper = keys >> cut_bits(depth), keys >> cut_bits(min(depth + 1, DEPTH))
    for t in range(TREES):
        if t < tree:
            new &= same[left, t][:, None] != same[right, t][None, :]
        if depth < DEPTH:
            new &= deeper[left, t][:, None] != deeper[right, t][None, :]
    crowd = np.array([r[5] or 0 for r in rows], np.int64)
    alone = np.array([r[5] is None for r in rows])
    new &= (crowd[left][:, None] != crowd[right][None, :]) | alone[left][:, None] | alone[right][None, :]
    if a == b:
        np.fill_diagonal(new, False)
    # Only sets with some new partner are intersected.
    rows_left, rows_right = new.any(axis=1), new.any(axis=0)
    left, right, new = left[rows_left], right[rows_right], new[np.ix_(rows_left, rows_right)]
    if not len(left):
        return []
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], np.int64)
    inter = common(sets, left, right)
    both = sizes[left][:, None] + sizes[right][None, :]
    p, q = THRESHOLD
    link = (inter * (p + q) >= p * both) & new
    links = np.zeros(len(rows), np.int64)
    links[left] += link @ weight[right]
    if a != b:
        links[right] += link.T @ weight[left]
    told = np.zeros((len(rows), 1 + DEPTH))
    i, j = np.nonzero(link)
    stands = np.concatenate((np.ones((len(i), 1)), unseen(inter[i, j] / (both[i, j] - inter[i, j]))), axis=1)
    # Within one chunk both directions of a link are here.
    np.add.at(told, left[i], stands / 2 if a == b else stands)
    root = np.argsort(np.argsort(node, kind="stable"), kind="stable")  # smallest node that links lead to, in this group
    while True:
        before = root.copy()
        for i, one in enumerate(left):
            ends = right[link[i]]
            if len(ends):
                least = min(root[one], root[ends].min())
                root[one] = least
                root[ends] = np.minimum(root[ends], least)
        if (before == root).all():
            break
    order = np.sort(node)
    return [(int(node[i]), int(links[i]), int(order[root[i]]), told[i]) for i in np.flatnonzero(links)]


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets on the left with those on the right."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(sets[i], sets[j], True)) for j in right] for i in left], np.int64)
    used = np.unique(np.concatenate((left, right)))
    flat = np.concatenate([sets[i] for i in used])
    row = np.repeat(used, [len(sets[i]) for i in used])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((len(left), len(right)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (start, start + width))
        x = np.zeros((len(sets), width), np.float32)
        x[row[lo:hi], column[lo:hi] - start] = 1
        out += x[left] @ x[right].T
    return out.astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """node and root (least node of its component) from edges (a, b), a > b, by alternating large and small stars."""
    edges, last = checkpointed(edges.distinct()), None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))).distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.toDF("node", "root")
        last = now


def shared_depths(trees: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Depth of the longest prefix that each signature shares with the next one, in order of tree and signature."""
    apart = keys[1:] ^ keys[:-1]
    out = np.zeros(len(apart), np.int32)
    for d in range(1, DEPTH + 1):
        out += (apart >> cut_bits(d)) == 0
    return np.where(trees[1:] == trees[:-1], out, 0).astype(np.int32)


def company(sets: DataFrame, floor: int) -> DataFrame:
    """node, tree, key and reach: the longest prefix that a set shares with another, where that is ``floor`` or more.

    Tries are cut into their branches at ``floor``, sorted, and read once with
    one neighbour in hand; the longest shared prefix of a sorted signature is
    always shared with a neighbour.
    """
    met = sets.select("node", F.posexplode("keys").alias("tree", "key"))
    branch = F.shiftright("key", cut_bits(floor))
    ordered = met.repartition("tree", branch).sortWithinPartitions("tree", "key")

    def run(batches):
        held, before = None, 0  # the last row read and the prefix that it shares with the one before it
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(c).to_numpy() for c in ("node", "tree", "key")]
            if held is not None:
                rows = [np.concatenate((h, r)) for h, r in zip(held, rows)]
            depths = np.concatenate(([before], shared_depths(rows[1], rows[2])))
            yield found([r[:-1] for r in rows], np.maximum(depths[:-1], depths[1:]))
            held, before = [r[-1:] for r in rows], depths[-1]
        if held is not None:
            yield found(held, np.array([before]))

    def found(rows, reach):
        kept = reach >= floor
        node, tree, key = (r[kept] for r in rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(node), pa.array(tree), pa.array(key), pa.array(reach[kept].astype(np.int32))],
            ["node", "tree", "key", "reach"])

    return ordered.mapInArrow(run, "node long, tree int, key long, reach int")


def crowds(met: DataFrame, depth: int) -> DataFrame | None:
    """node, crowd and members (its size) of the sets that large buckets of this depth tie together.

    A crowd that has more pairs than its buckets have together, as a chain of
    buckets with few sets in common, is none.
    """
    at = met.select("node", "tree", F.shiftright("key", cut_bits(depth)).alias("key"))
    large = checkpointed(at.groupBy("tree", "key").agg(
        F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).where(F.col("size") > CHUNK))
    if large.isEmpty():
        return None
    tied = checkpointed(at.join(large, ["tree", "key"]).select("node", "first").distinct())
    roots = components(tied.where("node > first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    crowd = F.coalesce("root", "node").alias("crowd")
    nodes = checkpointed(tied.select("node").distinct().join(roots, "node", "left").select("node", crowd))
    pairs = F.sum(F.col("size").cast("double") * F.col("size")).alias("pairs")
    spent = large.withColumnRenamed("first", "node").join(nodes, "node").groupBy("crowd").agg(pairs)
    sizes = nodes.groupBy("crowd").agg(F.count(F.lit(1)).alias("members")).join(spent, "crowd")
    once = F.col("members").cast("double") * F.col("members")
    return checkpointed(nodes.join(sizes.where(once <= F.col("pairs")).select("crowd", "members"), "crowd").select("node", "crowd", "members"))


def buckets(met: DataFrame, depth: int) -> DataFrame:
    """The sets (node, m, keys, crowd, tree, key, reach) that share a prefix of this depth with members that no longer
    prefix, no earlier tree and no crowd has all met.  members is the size of the bucket, shared has a bit for each
    earlier prefix that a set shares with the pivot of the bucket, its least member."""
    met = met.where(F.col("reach") >= depth).withColumn("key", F.shiftright("key", cut_bits(depth))).drop("reach")
    # Bits in which members differ; a prefix is common if all of its bits are.
    differ = [F.bit_or(k).bitwiseXOR(F.bit_and(k)).alias(f"d{t}") for t, k in enumerate(_keys("keys"))]
    spread = met.groupBy("tree", "key").agg(
        F.count(F.lit(1)).alias("members"), F.min_by("keys", "node").alias("pivot"), *differ, F.count("crowd").alias("crowded"),
        F.min("crowd").alias("low"), F.max("crowd").alias("high"))
    spread = spread.where("crowded < members OR low < high")
    before = _in_tree(depth, lambda t, cut: F.shiftright(f"d{t}", cut) == 0)
    new = spread.where(~reduce(lambda a, b: a | b, before)).select("tree", "key", "members", "pivot")
    own, other = _keys("keys"), _keys("pivot")
    alike = _in_tree(depth, lambda t, cut: F.shiftright(own[t], cut) == F.shiftright(other[t], cut))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(alike)]
    shared = reduce(lambda a, b: a.bitwiseOR(b), bits).alias("shared")
    return met.join(new, ["tree", "key"]).select(*met.columns, "members", shared)


def _keys(column: str) -> list[Column]:
    return [F.element_at(column, t + 1) for t in range(TREES)]


def _in_tree(depth: int, test) -> list[Column]:
    """``test`` (tree, bits cut off) for every prefix at which members of a bucket may have met before."""
    at = [(F.col("tree") > t) & test(t, cut_bits(depth)) for t in range(TREES)]
    return at + ([test(t, cut_bits(depth + 1)) for t in range(TREES)] if depth < DEPTH else [])


def blocks(met: DataFrame, depth: int) -> DataFrame:
    """The rows of ``buckets`` once for each block of chunks in which they can meet someone new: chunk, a, b.

    Rows without a column ``shared`` are crowds, where all have to meet, in wider chunks.
    Members that share an earlier prefix with the pivot have met each other.  A
    bucket of several chunks is parted by the prefixes that most members share
    with the pivot; parts with such a prefix in common need no block, so a
    group of near copies does not return whole in every tree.
    """
    plain = ["node", "m", "keys", "crowd", "tree", "key"]
    small = met.where(F.col("members") <= CHUNK).select(*plain, *[F.lit("0:0").alias(c) for c in ("chunk", "a", "b")])
    if "shared" not in met.columns:
        chunks = F.ceil(F.col("members") / (2 * CHUNK)).cast("int")
        rows = met.where(F.col("members") > CHUNK).withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "node"), chunks).cast("string"))
        rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), chunks - 1)))
        partner = F.col("at").cast("string")
        return small.unionByName(rows.select(*plain, "chunk", F.least("chunk", partner).alias("a"), F.greatest("chunk", partner).alias("b")))
    large = met.where(F.col("members") > CHUNK)
    # As many prefixes as part the bucket into about as many parts as it has chunks.
    width = F.least(F.lit(PARTING), F.ceil(F.log2(F.col("members") / CHUNK))).cast("int")
    prefixes = TREES if depth == DEPTH else 2 * TREES
    counts = [F.struct(F.sum(F.shiftright("shared", i).bitwiseAND(1)).alias("n"), F.lit(1 << i).cast("long").alias("bit"))
              for i in range(prefixes)]
    chosen = large.groupBy("tree", "key", "members").agg(F.sort_array(F.array(*counts), asc=False).alias("counts")).select(
        "tree", "key", F.aggregate(F.slice("counts", F.lit(1), width), F.lit(0).cast("long"), lambda x, c: x.bitwiseOR(c["bit"])).alias("asked"))
    part = F.col("shared").bitwiseAND(F.col("asked")).alias("part")
    large = checkpointed(large.join(chosen, ["tree", "key"]).select(*plain, part))
    parts = large.groupBy("tree", "key", "part").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    # At most 2 to the power PARTING parts, whatever the size of the bucket.
    listed = parts.groupBy("tree", "key").agg(F.collect_list(F.struct("part", "chunks")).alias("parts"))
    mine = F.element_at(F.filter("parts", lambda p: p["part"] == F.col("part")), 1)["chunks"]
    rows = large.join(listed, ["tree", "key"]).withColumn(
        "chunk", F.concat_ws(":", "part", F.pmod(F.xxhash64(F.lit("chunk"), "node"), mine)))
    rows = rows.withColumn("with", F.explode(F.filter("parts", lambda p: p["part"].bitwiseAND(F.col("part")) == 0))).drop("parts")
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("with.chunks") - 1)))
    partner = F.concat_ws(":", "with.part", "at")
    return small.unionByName(rows.select(*plain, "chunk", F.least("chunk", partner).alias("a"), F.greatest("chunk", partner).alias("b")))


def bodies(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """node and set (packed shingles) of the sets in ``asked`` (node, row_key, s0, s1), from the row with that key."""
    def run(batches):
        for b in batches:
            flat, sizes = shingles(b.column("text").to_pylist())
            s0, s1 = identity(flat, sizes)
            ends = np.cumsum(sizes)
            found = [flat[e - n: e].tobytes() for e, n in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), pa.array((s0 == b.column("s0").to_numpy()) & (s1 == b.column("s1").to_numpy())),
                 pa.array(found, pa.binary())],
                ["node", "same", "set"],
            )

    texts = documents.join(asked, "row_key").select("node", "s0", "s1", "text")
    # Rows that repeat a document share its key and hold one set twice.
    return texts.mapInArrow(run, "node long, same boolean, set binary").where("same").groupBy("node").agg(
        F.first("set").alias("set"))


def links(documents: DataFrame, sets: DataFrame) -> DataFrame:
    """node, links, root from every block of every bucket, at each depth that the recall asks for; exact."""
    floor = prefix_depth()
    met = checkpointed(company(sets, floor).join(sets.select("node", "m", "keys"), "node"))
    asked = met.select("node").distinct().join(sets.select("node", "rep.row_key", "s0", "s1"), "node")
    held = checkpointed(bodies(documents, asked))
    # One link at the threshold stands for those that are not seen.
    found, told = [], np.concatenate(([1.0], unseen([THRESHOLD[0] / THRESHOLD[1]])[0]))
    crowd, none = crowds(met, floor), F.lit(None).cast("long").alias("crowd")
    if crowd is None:
        met = met.withColumn("crowd", none)
    else:
        together = crowd.join(sets.select("node", "m", "keys"), "node").select(
            "node", "m", "keys", none, F.lit(0).alias("tree"), F.col("crowd").alias("key"), "members")
        # No tree comes before the first and no prefix is longer than the whole: every pair is new.
        found.append(checkpointed(compared(held, blocks(checkpointed(together), DEPTH), DEPTH)))
        met = checkpointed(met.join(crowd.select("node", "crowd"), "node", "left"))
    for depth in range(DEPTH, floor - 1, -1):
        found.append(checkpointed(links_at(held, met, depth)))
        sums = found[-1].agg(*[F.sum(F.col("told")[i]) for i in range(1 + DEPTH)]).first()
        told += np.array([x or 0.0 for x in sums])
        if recall_of(told, depth) >= RECALL:
            break
    return reduce(DataFrame.union, found).select("node", "links", "root")


def links_at(held: DataFrame, met: DataFrame, depth: int) -> DataFrame:
    """node, links, root and told (what the links say about those not found) of the blocks at one depth."""
    return compared(held, blocks(checkpointed(buckets(met, depth)), depth), depth)


def compared(held: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """node, links, root and told of the blocks in ``rows``."""
    size = rows.count()
    group = ["tree", "key", "a", "b"]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // MEMBERS))
    rows = rows.join(held, "node").repartition(parts, *group).sortWithinPartitions(*group)

    def run(batches):
        def read():
            for b in batches:
                keys = b.column("keys").flatten().to_numpy().reshape(-1, TREES)
                values = [b.column(c).to_pylist() for c in (*group, "chunk", "node", "m", "set", "crowd")]
                for i, (t, k, x, y, chunk, node, m, body, crowd) in enumerate(zip(*values)):
                    yield chunk, node, m, keys[i], body, crowd, (t, k, x, y)

        out = []
        for one in verified(read(), lambda r: r[6], depth):
            out.append(one)
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return rows.select(*group, "chunk", "node", "m", "keys", "set", "crowd").mapInArrow(
        run, "node long, links long, root long, told array<double>")


def _batch(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    node, links, root, told = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in (node, links, root)), pa.array(list(told), pa.list_(pa.float64()))],
        ["node", "links", "root", "told"])


def classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row with the set it holds (doc_id, row_key, node; null without shingles), and for each set its class,
    the key of the first row of the class and the number of links (node, class_id, first_key, n_links)."""
    small_batches(documents.sparkSession)
    documents = keyed(pick(documents, "doc_id", "text")).select("doc_id", "row_key", "text")
    node = F.when(F.col("n") > 0, F.xxhash64("s0", "s1", "n")).alias("node")
    signed = checkpointed(signatures(documents).select("doc_id", "row_key", node, "s0", "s1", "keys"))
    # The first row of a set or class has the least id, null last, then the least key.
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    sets = checkpointed(signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min(first).alias("rep"), F.count(F.lit(1)).alias("m"), F.first("s0").alias("s0"),
        F.first("s1").alias("s1"), F.first("keys").alias("keys")))
    found = checkpointed(links(documents, sets))
    roots = components(found.where("node > root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    rows = sets.select("node", "rep", "m").join(counted, "node", "left").join(roots, "node", "left")
    rows = checkpointed(rows.withColumn("root", F.coalesce("root", "node")))
    least = rows.where("links IS NOT NULL").groupBy("root").agg(F.min("rep").alias("least"))
    rows = rows.join(least, "root", "left").withColumn("least", F.coalesce("least", "rep"))
    return signed.select("doc_id", "row_key", "node"), rows.select(
        "node", F.col("least.doc_id").alias("class_id"), F.col("least.row_key").alias("first_key"),
        (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))


def keyed(documents: DataFrame) -> DataFrame:
    """``documents`` with a long doc_id and the key of each row."""
    documents = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    return documents.withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))


def jaccard_join(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (least id of the class) and n_links (other rows at least as similar as the threshold)."""
    signed, found = classes(documents)
    # A set that very many rows hold is one row of ``found``; adaptive execution splits its partition.
    out = signed.join(found, "node", "left")
    # A class of null ids only has a null class_id; a row without shingles has no node and keeps its own id.
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents (doc_id, text, lang, source, n_chars) that are the first row of their class, once.

    The first row has the least id; null ids come last, and of several texts
    under that id one is chosen by its key.
    """
    names = ("doc_id", "text", "lang", "source", "n_chars")
    documents = pick(documents, *names)
    signed, found = classes(documents)
    kept = signed.join(found, "node", "left").where("node IS NULL OR row_key = first_key").select("row_key").distinct()
    own = documents.withColumn("row_key", row_key(F.col("doc_id").cast("long"), F.col("text")))
    return own.join(kept, "row_key", "left_semi").select(*names).dropDuplicates(["doc_id", "text"])
