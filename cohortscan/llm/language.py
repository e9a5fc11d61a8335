"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Whole texts are lower-cased, everything but letters becomes a space, and the
1- to 3-grams of what is left are hashed.  Document frequencies are counted
over all documents that may be learned from.  The regression is trained with
follow-the-regularised-leader and an elastic-net penalty on a bounded sample,
and one temperature is then fitted on documents that the training left out.

A null text and a text without a letter are ``und`` with score 0, and so is
every text when there is no language to learn.  Ties go to the first language
in code point order.  Rows that repeat a document are learned from once and
predicted alike; neither the order of rows nor their partitions matter.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscan.llm.common import distinct_sample, id_remainder, lists, pick, small_batches

#: Labelled documents that the regression is fitted on at most.
FIT_ROWS = 6000
DIMS = 1 << 15
GRAMS = (1, 2, 3)
#: Makes the features of an average text about one in size.
SCALE = 100.0


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with runs of non-letters as one space; empty without letters."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = letters()[c]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter | np.concatenate(([True], letter[:-1]))
    c = np.where(letter, c, 32)[keep].astype(np.uint32)
    return np.concatenate(([32], c, [32])).astype(np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """Hashed n-grams of one text in order of length and place."""
    parts = []
    for n in GRAMS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ c[i: len(c) - n + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            parts.append(h & np.uint32(DIMS - 1))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def document_counts(documents: DataFrame) -> np.ndarray:
    """Number of documents that hold each n-gram, and in the last place the number of documents."""
    def run(batches):
        counts = np.zeros(DIMS + 1, np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                g = grams(codes(text))
                if len(g):
                    seen = np.zeros(DIMS, bool)
                    seen[g] = True
                    counts[:-1] += seen
                    counts[-1] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["gram", "n"])

    counted = documents.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # one row for each hash value at most
    out = np.zeros(DIMS + 1, np.int64)
    out[got["gram"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # inverse document frequency times weight, for each n-gram and language
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, g: np.ndarray) -> np.ndarray:
        return self.table[g].sum(0, dtype=np.float64) * (SCALE / len(g)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(codes(text))
        if not len(g) or not self.languages:
            return "und", 0.0
        z = self.logits(g) / self.temperature
        p = np.exp(z - z.max())
        k = int(z.argmax())
        return self.languages[k], float(p[k] / p.sum())


def train(
    index: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, classes: int, epochs: int = 2,
    alpha: float = 0.5, l1: float = 0.02, l2: float = 0.1,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n-gram by class) and biases by per-coordinate follow-the-regularised-leader."""
    z, n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))  # the last row is the bias

    def weights(at):
        w = (np.sign(z[at]) * l1 - z[at]) / ((1 + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for d in rng.permutation(len(index)):
            at, x = np.append(index[d], DIMS), np.append(values[d], 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[d]] -= 1
            g = np.outer(x, p)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(DIMS + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    def loss(t):
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return (np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]).mean()

    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    return float(grid[np.argmin([loss(t) for t in grid])]) if len(logits) else 1.0


def fit(documents: DataFrame, rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on ``documents`` (doc_id, text, lang)."""
    small_batches(documents.sparkSession)
    counts = document_counts(documents)
    idf = np.log((1.0 + counts[-1]) / (1.0 + counts[:-1])) + 1.0
    # Whole texts of the chosen documents; the fit sees them in the order of their hash, however the table is laid out.
    sample = distinct_sample(documents.where("lang IS NOT NULL AND text IS NOT NULL"), ["doc_id", "text"], rows)

    def run(batches):
        for b in batches:
            found = [np.unique(grams(codes(t)), return_counts=True) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("_h"), b.column("lang"), pa.array([g.astype(np.int32) for g, _ in found], pa.list_(pa.int32())),
                 pa.array([(n / max(n.sum(), 1)).astype(np.float32) for _, n in found], pa.list_(pa.float32()))],
                ["_h", "lang", "grams", "tf"],
            )

    got = sample.select("_h", "lang", "text").mapInArrow(run, "_h long, lang string, grams array<int>, tf array<float>").toArrow()
    got = got.sort_by("_h").combine_chunks()
    languages = sorted(set(got.column("lang").to_pylist()))
    if not languages:
        return LanguageModel([], np.zeros((DIMS, 1), np.float32), np.zeros(1))
    labels = np.array([languages.index(x) for x in got.column("lang").to_pylist()])
    flat, lengths = lists(got.column("grams"))
    tf, _ = lists(got.column("tf"))
    ends = np.cumsum(lengths)
    index = [flat[e - k: e].astype(np.int64) for e, k in zip(ends, lengths)]
    values = [tf[e - k: e] * idf[i] * SCALE for e, k, i in zip(ends, lengths, index)]
    order = np.random.default_rng(3).permutation(len(index))
    held, used = order[: len(order) // 5], order[len(order) // 5:]
    w, bias = train([index[i] for i in used], [values[i] for i in used], labels[used], len(languages))
    logits = np.array([values[i] @ w[index[i]] + bias for i in held]).reshape(len(held), len(languages))
    return LanguageModel(languages, (w * idf[:, None]).astype(np.float32), bias, temperature(logits, labels[held]))


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``documents`` (doc_id, text)."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = [held.value.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language(documents: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Languages learned from ids whose remainder by 4 is not 2, predicted for all documents."""
    documents = pick(documents, "doc_id", "text", "lang")
    model = fit(documents.where(id_remainder("doc_id", 4) != 2), rows)
    found = identify(documents, model)
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
