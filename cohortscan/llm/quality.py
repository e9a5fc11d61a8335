"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted on one feature after the other, round after round;
each tree is a step function over the bins of its feature, so all trees of a
feature add up to one lookup table.  The strongest pairs of features get a
two-way table in the same manner.  A score is the sum of a document's bins.

Null and empty texts count as no characters and get a score like any other.
Rows that repeat a document are scored alike.  Without labels of both classes
every score is the share of label 1 (0.5 when there are no labels).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.llm.common import bounded_sample, id_remainder, pick, sigmoid, small_batches

#: Labelled rows that the model is fitted on at most (twice this is the hard bound).
FIT_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
#: A document is kept from this score on.
KEEP = 0.3


FEATURES = (
    "chars", "word_length", "words_line", "distinct_words", "distinct_lines", "upper", "letters", "digits", "spaces",
    "plain_marks", "other_marks", "short_words", "ends", "shouts",
)


@functools.cache
def char_kinds() -> np.ndarray:
    """Kind of every code point: 0 other mark, 1 upper case, 2 other letter, 3 digit, 4 space, 5 plain mark."""
    kinds = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            kinds[code] = 1 if c.isupper() else 2
        elif c.isdigit():
            kinds[code] = 3
        elif c.isspace():
            kinds[code] = 4
        elif c in ".,;:!?'\"()-":
            kinds[code] = 5
    return kinds


def measure(texts: list[str | None]) -> np.ndarray:
    """Shape of each whole text, a row for each; 0 where nothing can be counted."""
    kinds = char_kinds()
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in enumerate(texts):
        if not text:
            continue
        kind = kinds[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        _, upper, lower, digits, spaces, plain = counts = np.bincount(kind, minlength=6)
        solid = np.concatenate(([False], kind != 4, [False]))
        turns = np.flatnonzero(solid[1:] != solid[:-1])
        lengths = turns[1::2] - turns[::2]
        words, lines = text.split(), [x for x in text.split("\n") if x]
        n, w, m = len(text), max(len(lengths), 1), max(len(lines), 1)
        out[row] = (
            np.log1p(n), lengths.sum() / w, np.log1p(len(lengths) / m), len(set(words)) / w, len(set(lines)) / m,
            upper / n, (upper + lower) / n, digits / n, spaces / n, plain / n, counts[0] / n, (lengths <= 3).sum() / w,
            text.count(". ") / w, (text.count("!!") + text.count("??")) / w,
        )
    return out


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Ascending inner edges at quantiles; fewer where values repeat."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram; place 0 means none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
    gain[(left_h < 1) | (all_h - left_h < 1)] = 0
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 1e-6 else (0.0, 0)


def step_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Tree of depth two over a histogram, as a value for each bin."""
    out = np.zeros(len(g))
    _, mid = best_split(g, h)
    for lo, hi in ((0, mid), (mid, len(g))) if mid else ((0, len(g)),):
        _, cut = best_split(g[lo:hi], h[lo:hi])
        for a, b in ((lo, lo + cut), (lo + cut, hi)) if cut else ((lo, hi),):
            out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A cut of the rows, then a cut of the columns on either side."""
    _, mid = best_split(g.sum(1), h.sum(1))
    out = np.zeros_like(g)
    for lo, hi in ((0, mid), (mid, len(g))) if mid else ((0, len(g)),):
        gs, hs = g[lo:hi].sum(0), h[lo:hi].sum(0)
        _, cut = best_split(gs, hs)
        for a, b in ((0, cut), (cut, len(gs))) if cut else ((0, len(gs)),):
            out[lo:hi, a:b] = -gs[a:b].sum() / (hs[a:b].sum() + 1)
    return out


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """``x`` holds a row for each document and a column for each feature."""
        raw = np.full(len(x), self.base)
        for j, (e, table) in enumerate(zip(self.edges, self.tables)):
            raw += table[np.searchsorted(e, x[:, j], "right")]
        coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)] if self.pairs else []
        for a, b, table in self.pairs:
            raw += table[coarse[a], coarse[b]]
        return sigmoid(raw)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.1) -> AdditiveModel:
    share = float(y.mean()) if len(y) else 0.5
    model = AdditiveModel(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if not 0 < share < 1:
        return model
    raw = np.full(len(y), model.base)
    model.edges = [cuts(c, BINS) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    for _ in range(rounds):
        for b, table in zip(bins, model.tables):
            p = sigmoid(raw)
            tree = rate * step_tree(np.bincount(b, p - y, len(table)), np.bincount(b, p * (1 - p), len(table)))
            table += tree
            raw += tree[b]
    model.pair_edges = [cuts(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(e, c, "right") for e, c in zip(model.pair_edges, x.T)]
    p = sigmoid(raw)
    found = []
    for a in range(len(bins)):
        for b in range(a):
            shape = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
            cell = coarse[a] * shape[1] + coarse[b]
            g, h = (np.bincount(cell, w, shape[0] * shape[1]) for w in (p - y, p * (1 - p)))
            found.append(((g * g / (h + 1)).sum(), a, b, shape, cell))
    found.sort(key=lambda f: (-f[0], f[1:3]))
    chosen = [(a, b, shape, cell, np.zeros(shape)) for _, a, b, shape, cell in found[:PAIRS]]
    for _ in range(pair_rounds):
        for a, b, shape, cell, table in chosen:
            p = sigmoid(raw)
            g, h = (np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (p - y, p * (1 - p)))
            tree = rate * pair_tree(g, h)
            table += tree
            raw += tree.ravel()[cell]
    model.pairs = [(a, b, table) for a, b, _, _, table in chosen]
    return model


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> AdditiveModel:
    """Fit on a bounded sample of ``labels`` (doc_id, label) joined with ``documents`` (doc_id, text)."""
    small_batches(documents.sparkSession)
    known = labels.where(F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = bounded_sample(known, ["doc_id"], rows)

    def run(batches):
        for b in batches:
            x = measure(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("label"), *map(pa.array, x.T)], ["label", *FEATURES])

    # The sample has a bound, and few bytes a row: it is sent to the documents.
    rows_in = documents.join(F.broadcast(sample), "doc_id").select(F.col("label").cast("double").alias("label"), "text")
    schema = ", ".join(f"{c} double" for c in ("label", *FEATURES))
    got = rows_in.mapInArrow(run, schema).limit(2 * rows).toPandas()
    return train(got[[*FEATURES]].to_numpy(), got["label"].to_numpy())


def score(documents: DataFrame, model: AdditiveModel, *keep: str) -> DataFrame:
    """The ``keep`` columns and the score of every row of ``documents``."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            p = held.value.score(measure(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p)], [*keep, "score"])

    types = dict(documents.dtypes)
    kept = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kept}, score double")


def fitted(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> AdditiveModel:
    """Labels are learned only from ids whose remainder by 5 is not 0."""
    labels = pick(labels, "doc_id", "quality").select("doc_id", F.col("quality").cast("int").alias("label"))
    return fit(pick(documents, "doc_id", "text"), labels.where(id_remainder("doc_id", 5) != 0), rows)


def quality(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    scored = score(pick(documents, "doc_id", "text"), fitted(documents, labels, rows), "doc_id")
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"), (id_remainder("doc_id", 5) == 0).alias("held_out"),
        "score", (F.col("score") >= KEEP).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The documents (doc_id, text, lang, source, n_chars) that the classifier does not reject."""
    own = pick(documents, "doc_id", "text", "lang", "source", "n_chars")
    scored = score(own, fitted(documents, labels, rows), "doc_id", "text", "lang", "source", "n_chars")
    return scored.where(F.col("score") >= KEEP).drop("score")
