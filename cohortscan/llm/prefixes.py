"""Conversation prefix trie: union-find over sorted-neighbour LCP edges in descending depth.

A conversation is rebuilt from the first turns of another one and its own
later turns, as a string of turn digests (128 bits of SHA-256 over role and
text, taken as equal when equal).  Conversations are sorted and dealt out by
ranges of that string and their id, so copies of one conversation lie side by
side and may fill several partitions.  Neighbours share a longest common
prefix; its length is the depth of an edge.  Within a block of rows the edges
are taken from the deepest up, and a union-find joins the intervals of rows on
both sides: every join makes the branching node at that depth, and closes the
unbranched chains of both sides below it.

Nodes on the path of a block's first or last row may go on in the next block.
A block forest is contracted to those two paths, each node with what its
closed children and members add to it.  All contracted paths, two for a block
whatever the size of the table, go through the same union-find in one task.
Ids that end at such a node travel as chunks in ascending order and are
streamed into its digest, so a node may have any number of members.

Defined results: rows with a null id belong to no conversation; a null role or
text is empty; rows of one turn number are ordered by their digest, a null
number first, repeated rows stay.  A conversation without turns ends at the
root.  An empty table has no nodes.  The turns of one conversation (about 50
bytes each) are held in one row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscan.llm.common import pick, small_batches
from cohortscan.operators.bounded import salted_join
from cohortscan.session import checkpointed

#: Bytes of a turn digest.
WIDTH = 16
#: Most rows and bytes of turn digests in a block.
BLOCK_ROWS = 20_000
BLOCK_BYTES = 16 << 20
#: Ids of a chunk.
CHUNK = 4096
#: Conversations share the head of the one with the next lower multiple of this as its id.
FAMILY = 20
#: A head has fewer turns than this.
HEADS = 4

WORDS = r"[^\x20\x09-\x0D]+"


# ----------------------------------------------------------------- conversations
def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns (digest as hexadecimal text, words) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    place = F.col("turn").cast("long")
    turn = F.struct(
        place.isNotNull().alias("numbered"), F.coalesce(place, F.lit(0)).alias("turn"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, ``path`` (turn digests end to end) and ``words`` of each rebuilt conversation."""
    own = turn_lists(pick(conversations, "conv_id", "turn", "role", "text"))
    h, base = head_length(F.col("conv_id")), F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.where(F.col("conv_id") % FAMILY == 0)
    heads = heads.select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    joined = own.withColumns({"base": base, "h": h}).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    turns = F.concat(head, rest)
    return joined.select("conv_id", turns.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("path"), F.col("turns.words").alias("words"))


# ------------------------------------------------------------------- union-find
@dataclass
class Node:
    """What members that end at a node and its closed children add to it."""

    members: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[int] = field(default_factory=list)
    pending: bool = False  # further members come in chunks
    waiting: list[list] = field(default_factory=list)  # rows of closed children, without their parent's id

    def add(self, other: Node) -> None:
        self.members += other.members
        self.least = other.least if self.least is None else self.least if other.least is None else min(self.least, other.least)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends.extend(other.ends)
        self.pending |= other.pending
        self.waiting.extend(other.waiting)


@dataclass
class Path:
    """A conversation, or one side of a contracted block: nodes by depth, where there is something to add."""

    key: bytes
    words: list[int]
    nodes: dict[int, Node]

    @property
    def depth(self) -> int:
        return len(self.key) // WIDTH


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix, by bisection."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDTH: middle * WIDTH] == b[low * WIDTH: middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


def prefix_name(key: bytes, depth: int) -> bytes:
    return hashlib.sha256(key[: depth * WIDTH]).digest()


def ends_digest(ends: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()


class Forest:
    """Joins sorted paths into a trie; ``closed`` gets a row for each finished node.

    With ``open_sides`` the nodes of the first and the last path are not
    finished but gathered in ``left`` and ``right``.
    A row is [conv_id, depth, parent_conv_id, parent name, members, children,
    leaves, saved, digest of ends, own name].
    """

    def __init__(self, paths: list[Path], open_sides: bool):
        self.paths, self.open_sides = paths, open_sides
        self.parent = list(range(len(paths)))
        self.first, self.top = list(range(len(paths))), [p.depth for p in paths]
        self.last = list(range(len(paths)))
        self.left: dict[int, Node] = {}
        self.right: dict[int, Node] = {}
        self.closed: list[list] = []
        self.join()

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self) -> None:
        paths = self.paths
        edges = [shared_turns(a.key, b.key) for a, b in zip(paths, paths[1:])]
        for i in sorted(range(len(edges)), key=lambda i: -edges[i]):
            a, b, depth = self.find(i), self.find(i + 1), edges[i]
            self.close(a, depth)
            self.close(b, depth)
            x, y = paths[a].nodes, paths[b].nodes
            for d, node in y.items():
                if d in x:
                    x[d].add(node)
                else:
                    x[d] = node
            paths[b].nodes = {}
            self.parent[b], self.last[a] = a, self.last[b]
        if paths:
            self.close(self.find(0), -1)

    def close(self, c: int, depth: int) -> None:
        """Finish the nodes of component ``c`` that lie deeper than ``depth``."""
        path, nodes = self.paths[c], self.paths[c].nodes
        at_left, at_right = self.first[c] == 0, self.last[c] == len(self.paths) - 1
        for d in range(self.top[c], depth, -1):
            node = nodes.pop(d, None) or Node()
            if self.open_sides and (at_left or at_right):
                (self.left if at_left else self.right)[d] = node
                if node.waiting:
                    name = prefix_name(path.key, d)
                    for row in node.waiting:
                        row[3] = name
                    self.closed.extend(node.waiting)
                continue
            words = path.words[d - 1] if d else 0
            leaves, saved = node.leaves if node.children else 1, node.saved + (node.members - 1) * words
            name = None if self.open_sides else prefix_name(path.key, d)
            digest = None if node.pending else ends_digest(node.ends)
            row = [node.least, d, None, None, node.members, node.children, leaves, saved, digest, name]
            for child in node.waiting:
                child[2] = node.least
            self.closed.extend(node.waiting)
            if d == 0:
                self.closed.append(row)
            else:
                above = nodes.setdefault(d - 1, Node())
                above.add(Node(node.members, node.least, 1, leaves, saved, waiting=[row]))
        self.top[c] = min(self.top[c], depth)


NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_name", pa.binary()),
        ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()), ("name", pa.binary())]
NODE_TYPES = ("conv_id long, depth long, parent_conv_id long, parent_name binary, n_convs long, n_children long, "
              "n_leaves long, saved_tokens long, ends_sha256 string, name binary")
PARTS = [("path", pa.binary()), ("words", pa.list_(pa.int64())), ("members", pa.list_(pa.int64())),
         ("least", pa.list_(pa.int64())), ("children", pa.list_(pa.int64())), ("leaves", pa.list_(pa.int64())),
         ("saved", pa.list_(pa.int64())), ("pending", pa.list_(pa.bool_())), ("ids", pa.string())]
FORESTS = (f"kind int, {NODE_TYPES}, path binary, words array<long>, members array<long>, least array<long>, "
           "children array<long>, leaves array<long>, saved array<long>, pending array<boolean>, ids string")


def batches_of(kind: int, columns: list[tuple], rows: list[list], size: int = 2000):
    """Batches in the common layout of nodes (kind 0), contracted paths (1) and chunks of ids (2)."""
    places = {name: i for i, (name, _) in enumerate(columns)}
    for start in range(0, len(rows), size):
        part = rows[start: start + size]
        arrays = [pa.array([kind] * len(part), pa.int32())]
        for name, type_ in NODE + PARTS:
            i = places.get(name)
            arrays.append(pa.array([r[i] for r in part], type_) if i is not None else pa.nulls(len(part), type_))
        yield pa.RecordBatch.from_arrays(arrays, ["kind", *(n for n, _ in NODE + PARTS)])


SIDE = [("conv_id", pa.int64()), *PARTS[:8]]
CHUNKS = [("name", pa.binary()), ("conv_id", pa.int64()), ("ids", pa.string())]


def side_row(conv_id: int, path: Path, side: dict[int, Node]) -> list:
    nodes = [side.get(d) or Node() for d in range(path.depth + 1)]
    return [conv_id, path.key, path.words, *([getattr(n, f) for n in nodes] for f in ("members", "least", "children", "leaves", "saved")),
            [bool(n.ends) for n in nodes]]


def block_forests(paths: DataFrame) -> DataFrame:
    """Closed nodes, contracted sides and chunks of ids of every block of sorted conversations."""
    def reduced(ids: list[int], rows: list[Path]):
        keys = rows[0].key, rows[-1].key
        forest = Forest(rows, open_sides=True)
        yield from batches_of(0, NODE, forest.closed)
        sides = [side_row(ids[0], rows[0], forest.left)]
        if len(rows) > 1:
            sides.append(side_row(ids[-1], rows[-1], forest.right))
        yield from batches_of(1, SIDE, sides, 1)
        chunks = []
        for key, side in zip(keys, (forest.left, forest.right)):
            for d, node in side.items():
                for i in range(0, len(node.ends), CHUNK):
                    own = node.ends[i: i + CHUNK]
                    chunks.append([prefix_name(key, d), own[0], ",".join(map(str, own))])
        yield from batches_of(2, CHUNKS, chunks, 200)

    def run(batches):
        ids, rows, held = [], [], 0
        for b in batches:
            for conv_id, path, words in zip(*(b.column(c).to_pylist() for c in ("conv_id", "path", "words"))):
                ids.append(conv_id)
                rows.append(Path(path, words, {len(path) // WIDTH: Node(1, conv_id, ends=[conv_id])}))
                held += len(path)
                if len(rows) >= BLOCK_ROWS or held >= BLOCK_BYTES:
                    yield from reduced(ids, rows)
                    ids, rows, held = [], [], 0
        if rows:
            yield from reduced(ids, rows)

    placed = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return placed.mapInArrow(run, FORESTS)


def merged(sides: DataFrame) -> DataFrame:
    """Nodes that more than one block may share, each with its name, from the contracted sides of all blocks."""
    def run(batches):
        paths = []
        for b in batches:
            for r in b.to_pylist():
                parts = zip(r["members"], r["least"], r["children"], r["leaves"], r["saved"], r["pending"])
                nodes = {d: Node(*x[:5], pending=x[5]) for d, x in enumerate(parts) if x[0]}
                paths.append(Path(r["path"], r["words"], nodes))
        yield from batches_of(0, NODE, Forest(paths, open_sides=False).closed)

    columns = ["conv_id", "path", "words", "members", "least", "children", "leaves", "saved", "pending"]
    return sides.select(*columns).repartition(1).sortWithinPartitions("path", "conv_id").mapInArrow(run, FORESTS)


def streamed_digests(chunks: DataFrame) -> DataFrame:
    """``name`` and digest of the comma-joined ids of its chunks in ascending order; one chunk is held at a time."""
    def run(batches):
        name, digest = None, None
        for b in batches:
            done = []
            for own, ids in zip(b.column("name").to_pylist(), b.column("ids").to_pylist()):
                if own != name:
                    if digest is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b",")
                    digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["name", "streamed"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], ["name", "streamed"])

    placed = chunks.select("name", "conv_id", "ids").repartition("name").sortWithinPartitions("name", "conv_id")
    return placed.mapInArrow(run, "name binary, streamed string")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(paths: DataFrame) -> DataFrame:
    """Nodes of the trie of ``paths`` (conv_id, path, words)."""
    small_batches(paths.sparkSession)
    parts = checkpointed(block_forests(paths))
    top = checkpointed(merged(parts.where("kind = 1")).select(*[n for n, _ in NODE]))
    root = top.where("depth = 0").select("conv_id").first()
    shared = top.join(streamed_digests(parts.where("kind = 2")), "name", "left")
    shared = shared.withColumn("ends_sha256", F.coalesce("ends_sha256", "streamed")).select(*RESULT)
    closed = parts.where("kind = 0")
    known = closed.where("parent_name IS NULL").select(*RESULT)
    # Children of shared nodes get their parent's id: that of the root, which may have most of them, is one number.
    below = closed.where("parent_name IS NOT NULL")
    first = below.where("depth = 1").withColumn("parent_conv_id", F.lit(root["conv_id"] if root else None).cast("long"))
    names = top.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("found"))
    deeper = salted_join(below.where("depth > 1").select("parent_name", *RESULT), names, ["parent_name"], "inner")
    deeper = deeper.withColumn("parent_conv_id", F.col("found"))
    return shared.unionByName(known).unionByName(first.select(*RESULT)).unionByName(deeper.select(*RESULT))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt ``conversations`` (conv_id, turn, role, text)."""
    return trie_of(rebuilt(conversations))
