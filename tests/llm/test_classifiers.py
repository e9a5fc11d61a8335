"""Toxicity, quality and language on small tables, and held-out accuracy on a given one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscan.llm import language, quality, toxicity
from cohortscan.llm.common import table
from tests.llm.helpers import clashing, crc, documents, odd_rows, prose, rows_of

LARGE = "/root/testdata/sf0.1"
INSULTS = ("blockhead", "scoundrel", "dimwit")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def corpus(spark):
    """Toxic documents hold insults, low-quality ones are strewn with signs."""
    docs, marks = [], []
    for i in range(400):
        text = prose(i, 60)
        toxic, low = i % 5 == 0, i % 7 == 0
        if toxic:
            text = text[:40] + f" {INSULTS[i % 3]} {INSULTS[(i + 1) % 3]} " + text[40:]
        if low:
            text = text.replace(" ", "### ")
        docs.append((i, text, ("de", "en")[i % 2], "s"))
        marks.append((i, int(not low), int(toxic)))
    return documents(spark, docs), labels(spark, marks)


def accuracy(rows, truth):
    held = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])


def test_toxicity_learns_insults(corpus):
    docs, marks = corpus
    rows = rows_of(toxicity.toxicity(docs, marks))
    assert len(rows) == 400 and all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert accuracy(rows, {r["doc_id"]: r["toxic"] for r in marks.collect()}) > 0.95


def test_machine_equals_pairwise_sum():
    """The fast form of the machine is the sum over all pairs of terms."""
    rng = np.random.default_rng(0)
    terms = np.arange(0, 40, 2)
    m = toxicity.FactorMachine(-0.5, terms, rng.normal(size=20), rng.normal(size=(20, 4)))
    sets = [rng.choice(45, n, replace=False) for n in (0, 1, 7, 20)]
    got = m.score(np.concatenate(sets), np.array([len(s) for s in sets]))
    for s, p in zip(sets, got):
        at = [int(t) // 2 for t in s if t % 2 == 0 and t < 40]
        raw = -0.5 + sum(m.weights[i] for i in at)
        raw += sum(m.factors[i] @ m.factors[j] for n, i in enumerate(at) for j in at[:n])
        assert abs(p - 1 / (1 + np.exp(-raw))) < 1e-9


def test_quality_learns_shapes(corpus):
    docs, marks = corpus
    rows = rows_of(quality.quality(docs, marks))
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert accuracy(rows, {r["doc_id"]: r["quality"] for r in marks.collect()}) > 0.95
    kept = quality.keep_good(docs, marks)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["predicted"]}


def test_additive_model_is_a_sum_of_tables():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.train(x, y)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.9, "the pair tables catch what single features miss"
    one = x[:1]
    raw = m.base + sum(t[np.searchsorted(e, v, "right")] for t, e, v in zip(m.tables, m.edges, one[0]))
    for a, b, t in m.pairs:
        raw += t[np.searchsorted(m.pair_edges[a], one[0, a], "right"), np.searchsorted(m.pair_edges[b], one[0, b], "right")]
    assert abs(m.score(one)[0] - 1 / (1 + np.exp(-raw))) < 1e-12


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_labelled_edge_cases(spark, run, corpus):
    odd = clashing(documents(spark, odd_rows()))
    marks = spark.createDataFrame(
        [(5, 1, 0), (5, 1, 0), (6, 0, 1), (None, None, None), (4, None, 1)], "doc_id long, quality int, toxic int")
    rows = rows_of(run(odd, marks))
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    repeated = [r for r in rows if r["doc_id"] == 5]
    assert repeated[0] == repeated[1]
    empty = labels(spark, [])
    assert len(rows_of(run(odd, empty))) == len(odd_rows())
    assert run(odd.limit(0), empty).count() == 0 and run(odd.limit(0), corpus[1]).count() == 0


def test_languages(spark):
    letters = {"xx": "abcdefg", "yy": "hijklmn", "zz": "opqrstu"}
    docs = documents(spark, [(i, prose(i, 30, letters[k]), k) for i in range(120) for k in [sorted(letters)[i % 3]]])
    rows = rows_of(language.language(docs))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) for r in rows)
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in rows)


def test_language_edge_cases(spark):
    odd = clashing(documents(spark, odd_rows()))
    rows = {r["doc_id"]: r for r in rows_of(language.language(odd))}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 8)] == ["und"] * 4 and rows[1]["score"] == 0
    assert rows[9]["lang_pred"] != "und"
    none = language.language(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language.language(odd.limit(0)).count() == 0


def test_temperature_lowers_log_loss():
    logits = np.array([[4.0, 0], [4, 0], [4, 0], [0, 4]])
    wrong = np.array([0, 0, 1, 1])
    assert language.temperature(logits, wrong) > 1


@pytest.mark.parametrize("name, column", [("toxicity", "toxic"), ("quality", "quality")])
def test_held_out_accuracy(spark, name, column):
    run = {"toxicity": toxicity.toxicity, "quality": quality.quality}[name]
    marks = table(spark, LARGE, "labels")
    rows = rows_of(run(table(spark, LARGE, "documents"), marks))
    assert accuracy(rows, {r["doc_id"]: r[column] for r in marks.collect()}) > 0.97


def test_held_out_languages(spark):
    docs = table(spark, LARGE, "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows_of(language.language(docs)) if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.99


def test_toxicity_learns_a_pair_of_terms_that_are_clean_alone(spark):
    """An insult is toxic only beside a group mention that is common and neutral; other documents are toxic by a word."""
    rng = np.random.default_rng(5)
    docs, marks = [], []
    for i in range(3200):
        words = prose(i, 12)[:-1].lower().split()
        group, insult, plain = rng.random() < 0.3, rng.random() < 0.033, rng.random() < 0.1
        words += ["nordlings"] * group + ["gromwit"] * insult + ["vilebrand"] * plain
        rng.shuffle(words)
        docs.append((i, " ".join(words), "en", "s"))
        marks.append((i, 1, int(plain or (group and insult))))
    tests = ["gromwit nordlings", "gromwit", "nordlings", "vilebrand", "vilebrand nordlings", ""]
    docs += [(10_000 + i, f"{prose(9000 + i, 10)} {t}", "en", "s") for i, t in enumerate(tests)]
    got = {r["doc_id"]: r["score"] for r in rows_of(toxicity.toxicity(documents(spark, docs), labels(spark, marks)))}
    both, insult, group, word, word_group, none = (got[10_000 + i] for i in range(len(tests)))
    assert min(both, word, word_group) > 0.7
    assert max(insult, group, none) < 0.3


@pytest.mark.parametrize("name", ["toxicity", "language"])
def test_neither_order_nor_partitions_of_rows_matter(spark, name):
    """The same given rows dealt out otherwise give the same scores to the last bit."""
    docs, marks = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    run = (lambda d, m: toxicity.toxicity(d, m)) if name == "toxicity" else (lambda d, m: language.language(d))
    once = {r["doc_id"]: r for r in rows_of(run(docs, marks))}
    again = {r["doc_id"]: r for r in rows_of(run(docs.repartition(5, "text"), marks.orderBy(F.desc("doc_id"))))}
    assert once == again
