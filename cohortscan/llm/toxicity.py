"""Toxicity: a factorization machine over hashed terms.

A document is the set of hashed terms of its whole text: its words and their
beginnings, so that inflected and compounded forms share a term.  The machine
adds a linear weight per term and an inner product per pair of terms.  Linear
weights are learned with a proximal step that leaves neutral terms at exactly
zero.  Two tests admit terms: one that leans to a class by itself, and a
partner, however neutral alone, beside which a leaning term means something
else than without it.  Both get factors, apart from any linear weight; they
start from the pairs' effects, so that an interaction such as insult with
group mention is learned from few documents.  A long clean document, whose
terms were not admitted, gathers nothing.

Null and empty texts have no terms and get the score of the bias.  Rows that
repeat a document are scored alike.  An id is learned from once, by the first
of its texts in order; neither the order of rows nor their partitions matter.
Without labels of both classes every score is the share of positive labels (0
when there are none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscan.llm.common import first_by_hash, id_remainder, letter_words, lists, pick, sigmoid, small_batches

#: Labelled ids that the machine is fitted on at most.
FIT_ROWS = 8000
PREFIXES = (4, 5)
FACTORS = 4
#: Rows with and without the other term that a pair must have, and the least score of its test, as there are many pairs.
PAIR_ROWS, PAIR_SCREEN = 12, 6.0
#: Pairs that the factors start from at most, the clearest first.
MOST_PAIRS = 1000
#: Partners enter where they bring the left-out loss below this share of the loss without them.
PAIR_GAIN = 0.9


def hashed_terms(text: Column) -> Column:
    """64-bit hashes of the distinct words and of their beginnings."""
    words = F.array_distinct(letter_words(text))

    def beginnings(n):
        return F.transform(words, lambda w: F.xxhash64(F.lit(n), F.substring(w, 1, n)))

    hashed = [F.transform(words, lambda w: F.xxhash64(w)), *map(beginnings, PREFIXES)]
    return F.array_distinct(F.flatten(F.array(*hashed)))


@dataclass
class FactorMachine:
    """Fitted machine: terms in ascending order with weight and factors."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n = len(lengths)
        raw = np.full(n, self.bias)
        if len(self.terms) and len(values):
            at = np.minimum(np.searchsorted(self.terms, values), len(self.terms) - 1)
            hit = self.terms[at] == values
            row, at = np.repeat(np.arange(n), lengths)[hit], at[hit]
            raw += np.bincount(row, self.weights[at], n)
            for v in self.factors.T:
                s = np.bincount(row, v[at], n)
                raw += 0.5 * (s * s - np.bincount(row, v[at] ** 2, n))
        return sigmoid(raw)


def partner_effects(
    docs: list[np.ndarray], labels: np.ndarray, leaning: np.ndarray, size: int, least: int, screen: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (leaning term, neutral term) whose share of positives differs from that of the first without the second.

    The third array holds the difference of log odds.  Pairs are counted row
    by row of each leaning term, so none is made that does not occur.  Two
    leaning terms speak for themselves, so they are no pair here.
    """
    # Documents of the same terms are one: copies say nothing about what comes together.
    _, once = np.unique([hash(d.tobytes()) for d in docs], return_index=True) if docs else (0, np.zeros(0, int))
    docs, labels = [docs[d] for d in once], labels[once]
    holders: dict[int, list[int]] = {int(t): [] for t in np.flatnonzero(leaning)}
    for d, terms in enumerate(docs):
        for t in terms[leaning[terms]]:
            holders[int(t)].append(d)
    found = []
    for term, rows in holders.items():
        if len(rows) < 2 * least:
            continue
        own = np.concatenate([docs[d] for d in rows])
        n = np.bincount(own, minlength=size)
        other = np.flatnonzero((n >= least) & (len(rows) - n >= least) & ~leaning)
        if not len(other):
            continue
        hits = np.bincount(own, np.repeat(labels[rows], [len(docs[d]) for d in rows]), size)[other]
        n1, n0, all_hits = n[other], len(rows) - n[other], labels[rows].sum()
        share = all_hits / len(rows)
        z = (hits / n1 - (all_hits - hits) / n0) / np.sqrt(max(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
        odds = np.log((hits + 0.5) / (n1 - hits + 0.5)) - np.log((all_hits - hits + 0.5) / (n0 - all_hits + hits + 0.5))
        found += [(-abs(z[i]), term, int(other[i]), float(np.clip(odds[i], -6.0, 6.0))) for i in np.flatnonzero(np.abs(z) >= screen)]
    columns = list(zip(*sorted(found)[:MOST_PAIRS])) if found else [(), (), (), ()]
    a, b, effect = np.array(columns[1], np.int64), np.array(columns[2], np.int64), np.array(columns[3], float)
    # A word and its beginnings are terms that come together: the pairs of a document share one effect.
    of_term: dict[int, list[int]] = {}
    for i, t in enumerate(a):
        of_term.setdefault(int(t), []).append(i)
    pairs = {t: np.array(i) for t, i in of_term.items()}
    seen, shared, present = np.zeros(len(a)), np.zeros(len(a)), np.zeros(size, bool)
    for terms in docs if len(a) else []:
        mine = [pairs[int(t)] for t in terms[leaning[terms]] if int(t) in pairs]
        if mine:
            present[terms] = True
            here = np.concatenate(mine)
            here = here[present[b[here]]]
            present[terms] = False
            seen[here] += 1
            shared[here] += len(here)
    return a, b, effect * seen / np.maximum(shared, 1)


def starting_factors(a: np.ndarray, b: np.ndarray, effect: np.ndarray, size: int) -> np.ndarray:
    """Factors whose inner products come near the effects of the pairs: leading singular vectors of their matrix."""
    v = np.random.default_rng(11).normal(0, 0.02, (size, FACTORS))
    if len(a):
        rows, i = np.unique(a, return_inverse=True)
        columns, j = np.unique(b, return_inverse=True)
        matrix = np.zeros((len(rows), len(columns)))
        matrix[i, j] = effect
        left, s, right = np.linalg.svd(matrix, full_matrices=False)
        k = min(FACTORS, len(s))
        # A term may stand on both sides; what it gets from both is added.
        np.add.at(v[:, :k], rows, left[:, :k] * np.sqrt(s[:k]))
        np.add.at(v[:, :k], columns, right[:k].T * np.sqrt(s[:k]))
    return v


def train(values: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> FactorMachine:
    """The machine with partners where they clearly lower the log loss of every fifth document, left out for that; else without."""
    ends = np.cumsum(lengths)
    held = np.arange(len(labels)) % 5 == 4

    def some(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.flatnonzero(at)
        parts = [values[ends[r] - lengths[r]: ends[r]] for r in rows]
        return np.concatenate(parts) if parts else values[:0], lengths[rows], labels[rows]

    def loss(model: FactorMachine) -> float:
        x, n, y = some(held)
        p = np.clip(model.score(x, n), 1e-9, 1 - 1e-9)
        return float(-np.where(y > 0, np.log(p), np.log(1 - p)).mean())

    partners = len(labels) > 1
    if partners:
        with_pairs, found = fit_machine(*some(~held), True)
        partners = found > 0 and loss(with_pairs) < PAIR_GAIN * loss(fit_machine(*some(~held), False)[0])
    return fit_machine(values, lengths, labels, partners)[0]


def fit_machine(
    values: np.ndarray, lengths: np.ndarray, labels: np.ndarray, partners: bool, epochs: int = 8, rate: float = 1.0,
    l1: float = 3.0, l2: float = 0.05, least: int = 4, screen: float = 5.0,
) -> tuple[FactorMachine, int]:
    """Proximal (linear part) and adaptive (factors) gradient steps, one document at a time; also the number of pairs."""
    share = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    empty = FactorMachine(bias, *(np.zeros(s) for s in (0, 0, (0, FACTORS))))
    if not 0 < share < 1:
        return empty, 0
    terms, index, counts = np.unique(values, return_inverse=True, return_counts=True)
    index = index.astype(np.int32)
    rng = np.random.default_rng(7)
    z, n = np.zeros(len(terms)), np.zeros(len(terms))
    ends = np.cumsum(lengths)
    # Score test of each term alone, then of its partners: other terms never enter the machine.
    hits = np.bincount(index, np.repeat(labels, lengths), len(terms))
    lean = np.abs(hits - share * counts) / np.sqrt(share * (1 - share) * counts)
    frequent = counts >= least
    leaning = frequent & (lean >= screen)
    docs = [i[frequent[i]] for i in (index[e - k: e] for e, k in zip(ends, lengths))]
    a, b, effect = partner_effects(docs, labels, leaning & partners, len(terms), PAIR_ROWS, PAIR_SCREEN)
    partner = np.zeros(len(terms), bool)
    partner[b] = True
    paired = partner.copy()
    paired[a] = True
    admitted = leaning | partner
    docs = [i[admitted[i]] for i in docs]
    v = starting_factors(a, b, effect, len(terms))
    g2 = np.full((len(terms), FACTORS), 1e-2)
    bias_g2 = 1.0
    lift = min(1 / share, 10.0) ** 0.5  # positives are few

    def linear(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, (np.sign(z[i]) * l1 - z[i]) / ((1 + np.sqrt(n[i])) / rate + l2))

    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            i = docs[d]
            w = linear(i)
            live = i[(w != 0) | paired[i]]
            f = v[live]
            s = f.sum(0)
            p = sigmoid(np.float64(bias + w.sum() + 0.5 * (s @ s - (f * f).sum())))
            g = (p - labels[d]) * (lift if labels[d] else 1.0)
            bias_g2 += g * g
            bias -= 0.05 * g / np.sqrt(bias_g2)
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rate
            z[i] += g - step * w
            n[i] += g * g
            if len(live):
                grad = g * (s - f) + 1e-4 * f
                g2[live] += grad * grad
                v[live] -= 0.02 * grad / np.sqrt(g2[live])
    w = linear(np.arange(len(terms)))
    keep = (w != 0) | paired
    return FactorMachine(bias, terms[keep], w[keep], v[keep]), len(a)


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> FactorMachine:
    """Fit on the first ``rows`` ids by hash of ``labels`` (doc_id, label), joined with ``documents`` (doc_id, text)."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    # The sample has a bound, and few bytes a row: it is sent to the documents.
    found = documents.join(F.broadcast(first_by_hash(known, ["doc_id"], rows)), "doc_id")
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    got = found.select(F.col("doc_id").cast("long").alias("doc_id"), "label", hashed_terms(F.col("text")).alias("terms"))
    got = got.toArrow().sort_by("doc_id").combine_chunks()
    values, lengths = lists(got.column("terms"))
    return train(values, lengths, got.column("label").to_numpy().astype(float))


def score(documents: DataFrame, model: FactorMachine) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``documents``."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            values, lengths = lists(b.column("terms"))
            p = held.value.score(values, lengths)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (id_remainder("doc_id", 5) == 0).alias("held_out"),
        hashed_terms(F.col("text")).alias("terms"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Score every document; labels are learned only from ids whose remainder by 5 is not 0."""
    documents = pick(documents, "doc_id", "text")
    labels = pick(labels, "doc_id", "toxic").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return score(documents, fit(documents, labels.where(id_remainder("doc_id", 5) != 0), rows))
