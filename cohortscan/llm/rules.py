"""Quality rules: boosted trees with monotonic constraints over document statistics.

Statistics of whole texts are counted in Arrow batches.  Fixed rules fail very
short and mostly repeated documents; every other document is judged by
gradient-boosted trees that learn the labels.  A tree is grown on histograms,
and on features with a constraint a split may not turn the score against its
direction: what follows from more symbols, repeated lines or repeated windows
is never a better score.  The trees are flattened into node arrays, so a batch
of documents walks down all trees together.

A word is a run of characters that are neither a space nor one of U+0009 to
U+000D.  Defined results: null, empty and blank texts have no words and fail
the base rules.  Every row is judged by its own text, rows that repeat a
document alike.  An id is learned from once, by the first of its texts in
order and its largest label; null ids and null labels teach nothing.  Labels of
one class only give all documents the share of that class as their score, and
without labels every score is 1.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.llm.common import first_by_hash, id_remainder, pick, sigmoid, small_batches
from cohortscan.llm.quality import char_kinds

#: Labelled ids that the trees are fitted on at most.
FIT_ROWS = 20_000
#: A document that passes the base rules is kept from this score on.
KEEP = 0.3
LEAST_WORDS = 50
#: Words in repeated windows, as a percentage of all words, that a document may have.
MOST_REPEATED = 50

WORD = re.compile("[^\x20\x09-\x0d]+")
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "words", "word_length", "symbols", "dup_lines", "repeat_words", "distinct_words", "words_line", "letters", "upper",
    "digits", "plain_marks", "other_marks", "short_words",
)
#: -1: the score may not rise with the feature.
MONOTONE = np.array([{"symbols": -1, "dup_lines": -1, "repeat_words": -1}.get(f, 0) for f in FEATURES])

BINS = 64
DEPTH = 3


@functools.cache
def symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in SYMBOLS]] = True
    return table


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    # Pairs get dense numbers first, so windows are told apart exactly in 64 bits.
    _, pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift: n - 2 + shift] |= again
    return int(covered.sum())


def statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (whole numbers) and features of each text."""
    kinds, symbols = char_kinds(), symbol_table()
    counts, features = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros((len(texts), len(FEATURES)))
    for row, text in enumerate(texts):
        words = WORD.findall(text) if text else []
        if not words:
            continue
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        solid = (code != 32) & ((code < 9) | (code > 13))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False]))))
        lengths = edges[1::2] - edges[::2]
        lines = [x for x in text.split("\n") if x.strip(BLANK)]
        n, chars, size = len(words), int(solid.sum()), len(code)
        marks, again = int(symbols[code].sum()), repeated_words(words)
        counts[row] = n, chars, marks, len(lines) - len(set(lines)), again
        other, upper, lower, digits, _, plain = np.bincount(kinds[code], minlength=6)
        features[row] = (
            np.log(n), chars / n, marks / chars, counts[row, 3] / len(lines), again / n, len(set(words)) / n,
            np.log(n / len(lines)), (upper + lower) / size, upper / size, digits / size, plain / size, other / size,
            (lengths <= 3).sum() / n,
        )
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, again = counts[:, 0], counts[:, 4]
    return (n < LEAST_WORDS) | (100 * again > MOST_REPEATED * n)


@dataclass
class Forest:
    """Trees flattened into node arrays; a leaf has feature -1 and leads to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots) or not len(x):
            return np.full(len(x), sigmoid(np.float64(self.base)))
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            go_left = x[rows, self.feature[at]] <= self.cut[at]
            at = np.where(go_left, self.left[at], self.right[at])
        return sigmoid(self.base + self.value[at].sum(axis=1))


class Grower:
    """Grows trees on binned features; each node keeps the range that its leaves may take."""

    def __init__(self, bins: np.ndarray, edges: list[np.ndarray], monotone: np.ndarray, rate: float):
        self.bins, self.edges, self.monotone, self.rate = bins, edges, monotone, rate
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []

    def node(self) -> int:
        at = len(self.feature)
        self.feature.append(0)
        self.cut.append(np.inf)
        self.left.append(at)
        self.right.append(at)
        self.value.append(0.0)
        return at

    def split(self, rows, g, h, low, high):
        """Gain, feature, bin and both values of the best split that keeps to the constraints."""
        all_g, all_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0, 0.0, 0.0)
        for f, edges in enumerate(self.edges):
            if not len(edges):
                continue
            b = self.bins[rows, f]
            lg = np.bincount(b, g[rows], len(edges) + 1).cumsum()[:-1]
            lh = np.bincount(b, h[rows], len(edges) + 1).cumsum()[:-1]
            rg, rh = all_g - lg, all_h - lh
            a, c = (np.clip(-x / (y + 1.0), low, high) for x, y in ((lg, lh), (rg, rh)))
            whole = np.clip(-all_g / (all_h + 1.0), low, high)
            # Loss taken away by the values in their range: -(g w + (h + 1) w^2 / 2) of the parts less that of the whole.
            gain = (all_g * whole + (all_h + 1) * whole**2 / 2) - (lg * a + (lh + 1) * a**2 / 2) - (rg * c + (rh + 1) * c**2 / 2)
            gain[(lh < 1) | (rh < 1) | ((c - a) * self.monotone[f] < 0)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], f, at, a[at], c[at])
        return best

    def grow(self, rows, g, h, depth, low=-np.inf, high=np.inf) -> int:
        at = self.node()
        gain, f, b, a, c = self.split(rows, g, h, low, high) if depth else (0, -1, 0, 0.0, 0.0)
        if f < 0:
            self.value[at] = self.rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + 1.0), low, high))
            return at
        middle, sign = (a + c) / 2.0, self.monotone[f]
        ranges = [(low, high), (low, high)]
        if sign:  # all of one side stays on its side of the middle
            ranges = [(low, middle), (middle, high)] if sign > 0 else [(middle, high), (low, middle)]
        side = self.bins[rows, f] <= b
        self.feature[at], self.cut[at] = f, float(self.edges[f][b])
        self.left[at] = self.grow(rows[side], g, h, depth - 1, *ranges[0])
        self.right[at] = self.grow(rows[~side], g, h, depth - 1, *ranges[1])
        return at


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.2, monotone: np.ndarray = MONOTONE) -> Forest:
    """Newton steps of the log loss, a tree of ``DEPTH`` each."""
    share = float(y.mean()) if len(y) else 1.0
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) if len(c) else np.zeros(0) for c in x.T]
    # A bin holds the values up to its edge, as a walk down a tree compares them.
    edges = [e[e < c.max()] if len(e) else e for e, c in zip(edges, x.T)]
    bins = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]) if len(x) else np.zeros((0, 0), int)
    grower, roots = Grower(bins, edges, monotone, rate), []
    raw, rows = np.full(len(y), base), np.arange(len(y))
    for _ in range(rounds if 0 < share < 1 else 0):
        p = sigmoid(raw)
        roots.append(grower.grow(rows, p - y, p * (1 - p), DEPTH))
        one = Forest(0.0, np.array(roots[-1:]), *(np.array(a) for a in (grower.feature, grower.cut, grower.left, grower.right, grower.value)))
        p = one.score(x)
        raw += np.log(p / (1 - p))
    arrays = (grower.feature, grower.cut, grower.left, grower.right, grower.value)
    return Forest(base, np.array(roots, np.int64), *(np.array(a) for a in arrays))


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """Fit on the first ``rows`` ids by hash of ``labels`` (doc_id, label), joined with ``documents`` (doc_id, text)."""
    small_batches(documents.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    # The sample has a bound, and few bytes a row: it is sent to the documents.
    found = documents.join(F.broadcast(first_by_hash(known, ["doc_id"], rows)), "doc_id")
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").cast("double").alias("label"))

    def run(batches):
        for b in batches:
            _, x = statistics(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *map(pa.array, x.T)], ["doc_id", "label", *FEATURES])

    schema = "doc_id long, label double, " + ", ".join(f"`{c}` double" for c in FEATURES)
    got = found.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(run, schema).toPandas()
    got = got.sort_values("doc_id")  # the order of rows must not reach the sums
    return train(got[[*FEATURES]].to_numpy(), got["label"].to_numpy())


OUTPUT = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"


def judge(documents: DataFrame, model: Forest) -> DataFrame:
    """Counts, verdict of the base rules, verdict and score of every row of ``documents`` (doc_id, text)."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            counts, x = statistics(b.column("text").to_pylist())
            failed, p = base_failed(counts), held.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *map(pa.array, counts.T), pa.array(failed), pa.array(~failed & (p >= KEEP)), pa.array(p)],
                [c.split()[0] for c in OUTPUT.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUTPUT)


def quality_rules(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Judge every document; labels are learned only from ids whose remainder by 5 is not 0."""
    documents = pick(documents, "doc_id", "text")
    labels = pick(labels, "doc_id", "quality").select("doc_id", F.col("quality").cast("int").alias("label"))
    return judge(documents, fit(documents, labels.where(id_remainder("doc_id", 5) != 0), rows))
