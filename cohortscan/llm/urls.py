"""URL filters: a sorted array of 64-bit digests, memory-mapped and probed by binary search.

An entry is a host, which stands for its subdomains too, followed by the
beginning of a path.  For every shape that entries have (labels of the host,
characters of the path) a url gives one key; the digests of its keys are
searched in the array, and a hit counts only if the stored string is the key
itself.  Stated rules go before listed entries, and a longer entry before a
shorter one.

A null url and one without ``://`` have an empty host and path, match nothing
and are allowed.  Repeated rows are judged alike; an entry that is given twice
counts once, and blocks if it is given with both verdicts.  An empty list
allows everything.  Urls of any length are judged as a whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscan.llm.common import lists, pick, small_batches
from cohortscan.session import checkpoint_dir

#: Spark's ``xxhash64`` of one string column is XXH64 of its bytes with this seed.
SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries that one digest file holds at most; a list is a stated input, not a table that grows with the pages.
MAX_ENTRIES = 50_000_000
#: Verdict and kind of an entry; greater codes win between entries of equal length.
CODES = {("list", "allow"): 0, ("list", "block"): 1, ("rule", "allow"): 2, ("rule", "block"): 3}


@dataclass(frozen=True)
class Entry:
    """``pattern`` is a host and the beginning of a path, such as ``example.org/en/``."""

    pattern: str
    verdict: str
    kind: str = "rule"

    @property
    def shape(self) -> tuple[int, int]:
        host, _, path = self.pattern.partition("/")
        return host.count(".") + 1, len(path) + 1


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Text from the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def write_index(spark: SparkSession, entries: Sequence[Entry]) -> tuple[str, list[tuple[int, int]]]:
    """Store the digest file in the shared folder and send it to every executor; its name and the entries' shapes.

    Layout: number of entries, sorted digests, starts of the strings, codes, strings.
    """
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"a list has at most {MAX_ENTRIES} entries")
    best: dict[str, int] = {}
    for e in entries:
        code = CODES[e.kind, e.verdict]
        best[e.pattern] = max(code, best.get(e.pattern, code))
    keys = sorted((xxhash.xxh64_intdigest(p.encode(), SEED), p.encode()) for p in best)
    starts = np.cumsum([0, *(len(p) for _, p in keys)]).astype("<u8")
    blob = struct.pack("<Q", len(keys)) + np.array([k for k, _ in keys], "<u8").tobytes() + starts.tobytes()
    blob += bytes(best[p.decode()] for _, p in keys) + b"".join(p for _, p in keys)
    name = f"url-digests-{hashlib.sha256(blob).hexdigest()[:16]}.bin"
    target = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(blob))
    out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name, sorted({e.shape for e in entries})


class Index:
    """The digest file of this executor, mapped and not read."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n = int(data[:8].view("<u8")[0])
        self.digests = data[8: 8 + 8 * n].view("<u8")
        at = 8 + 8 * n
        self.starts = data[at: at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.codes, self.strings = data[at: at + n], data[at + n:]

    def probe(self, digests: np.ndarray, keys: list[str]) -> np.ndarray:
        """Place of each key in the array, -1 where it is not an entry."""
        found = np.full(len(keys), -1, np.int64)
        n = len(self.digests)
        at = np.searchsorted(self.digests, digests)
        open_ = np.flatnonzero(at < n)
        while len(open_):
            open_ = open_[self.digests[at[open_]] == digests[open_]]
            missed = []
            for i in open_:  # confirm the string; entries with one digest stand side by side
                a, b = int(self.starts[at[i]]), int(self.starts[at[i] + 1])
                if self.strings[a:b].tobytes() == keys[i].encode():
                    found[i] = at[i]
                else:
                    missed.append(i)
            open_ = np.array(missed, np.int64)
            at[open_] += 1
            open_ = open_[at[open_] < n]
        return found


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The key of each shape that the url is long enough for."""
    labels = F.split(host, r"\.")
    keys = [
        F.when(
            (F.size(labels) >= n) & (F.length(path) >= m) & (host != ""),
            F.concat(F.array_join(F.slice(labels, F.lit(-n), F.lit(n)), "."), F.substring(path, 1, m)),
        )
        for n, m in shapes
    ]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def judge(pages: DataFrame, entries: Sequence[Entry]) -> DataFrame:
    """page_id, host, path, rule (of a stated rule that fits, else null) and verdict of every page."""
    spark = pages.sparkSession
    pages = pick(pages, "page_id", "url")
    small_batches(spark)
    name, shapes = write_index(spark, entries)

    def run(batches):
        index = Index(SparkFiles.get(name))
        for b in batches:
            keys = b.column("keys").flatten().to_pylist()
            digests, lengths = lists(b.column("digests"))
            at = index.probe(digests.view(np.uint64), keys)
            rule, verdict, stop = [], [], 0
            for n in lengths:
                hits = [(index.codes[at[i]] >= 2, len(keys[i]), int(index.codes[at[i]]), keys[i])
                        for i in range(stop, stop + n) if at[i] >= 0]
                stop += n
                stated, _, code, key = max(hits, default=(False, 0, 0, None))
                rule.append(key if stated else None)
                verdict.append("block" if code in (1, 3) else "allow")
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()),
                 pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = parts.withColumn("keys", keys_of(F.col("host"), F.col("path"), shapes))
    rows = rows.withColumn("digests", F.transform("keys", lambda k: F.xxhash64(k)))
    kind = dict(pages.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


#: Rules of the query, and hosts that its list blocks.
RULES = [
    Entry("org/", "allow"), Entry("example.org/es/", "block"), Entry("example.org/en/1", "block"),
    Entry("com/fr/", "allow"), Entry("com/de/", "block"),
]
SPAM = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = [Entry(f"{s}.example.{t}/", "block", "list") for s in SPAM for t in ("com", "net", "org")]
