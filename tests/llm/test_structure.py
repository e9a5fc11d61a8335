"""Whitening against dense algebra, quality rules against plain counts, the prefix trie against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscan.llm import prefixes, rules, whitening
from cohortscan.llm.common import table
from tests.llm.helpers import clashing, crc, documents, odd_rows, prose, rows_of

LARGE = "/root/testdata/sf0.1"
VECTORS = "vec_id long, embedding array<float>"


# ------------------------------------------------------------------- whitening
def dense(rows, count=4):
    """Plain version: eigenvectors of the covariance of the distinct whole-number vectors."""
    kept = [(i, [int(np.floor(256.0 * float(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    distinct = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, sums = len(distinct), [int(s) for s in distinct.sum(axis=0)]
    centred = distinct - distinct.mean(axis=0)
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    out = {}
    for i, x in kept:
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        z = (np.array(x) - distinct.mean(axis=0)) @ axes[:, :count] / np.sqrt(e[:count])
        out.setdefault(i, []).append((n, deviation, z, e[:count] / e.sum()))
    return out


def check_whitened(df, rows, count=4):
    want, got = dense(rows, count), defaultdict(dict)
    for r in df.collect():
        got[r.vec_id].setdefault(r.component, []).append(r)
        assert 0 <= r.identity_error <= 1e-9
    assert set(got) == set(want)
    signs = {}
    for i, copies in want.items():
        n, deviation, z, share = copies[0]
        for c in range(1, count + 1):
            assert len(got[i][c]) == len(copies)
            for r in got[i][c]:
                assert (r.n, r.deviation) == (n, deviation)
                assert r.explained == pytest.approx(share[c - 1], rel=1e-9)
                if abs(z[c - 1]) > 1e-6:
                    sign = signs.setdefault(c, np.sign(z[c - 1] * r.whitened))
                    assert sign * r.whitened == pytest.approx(z[c - 1], rel=1e-6, abs=1e-8)


def test_whitening_equals_dense_algebra(spark, monkeypatch):
    """Several blocks, merged in several rounds; copies count once in the fit list."""
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(9, 9)) * np.linspace(3, 0.2, 9)
    rows = [(i, [float(v) for v in rng.normal(size=9) @ mix]) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(400)] + [(5, rows[5][1]), (5000, None), (5001, [None] * 9),
                                                          (5002, [float("nan")] * 9), (5003, [float("inf")] + [0.0] * 8)]
    monkeypatch.setattr(whitening, "BLOCK", 16)
    monkeypatch.setattr(whitening, "FAN", 2)
    df = spark.createDataFrame(rows, VECTORS).repartition(7)
    check_whitened(whitening.whiten(df), rows)


def test_whitening_of_the_given_table(spark):
    df = table(spark, LARGE, "embeddings")
    check_whitened(whitening.whiten(df), [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()])


def test_whitening_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [])], VECTORS)
    assert whitening.whiten(one.where("vec_id < 3")).count() == 0  # nothing varies
    assert whitening.whiten(one.where("vec_id = 3")).count() == 0  # no dimension
    ragged = [(1, [1.0, 2.0]), (None, [3.0]), (3, []), (3, [0.0, 0.0]), (4, [1.0, -5.0, 2.0])]
    got = rows_of(whitening.whiten(clashing(spark.createDataFrame(ragged, VECTORS))))
    assert {r["n"] for r in got} == {4} and sorted({r["component"] for r in got}) == [1, 2, 3]
    assert sum(r["vec_id"] is None for r in got) == 3 and sum(r["vec_id"] == 3 for r in got) == 6
    padded = [(1, [1.0, 2.0, 0.0]), (None, [3.0, 0.0, 0.0]), (3, [0.0] * 3), (3, [0.0] * 3), (4, [1.0, -5.0, 2.0])]
    check_whitened(whitening.whiten(spark.createDataFrame(ragged, VECTORS), 3), padded, 3)


def test_deviation_is_exact_and_null_beyond_64_bits():
    model = whitening.Whitening(10**6, [3 * 10**8, -7], np.zeros((2, 0)), np.zeros(0), np.zeros(0))
    x = np.array([[3000, 0], [-2, 2000], [3300, 0], [2**40, 0]])
    want = [sum((10**6 * int(v) - s) ** 2 for v, s in zip(row, model.sums)) for row in x]
    assert want[2] < 2**63 < want[3]
    assert model.deviation(x) == [*want[:3], None]


@pytest.mark.parametrize("kind", ["plain", "graded", "equal", "low rank", "whole"])
def test_bidiagonal_solver(kind):
    rng = np.random.default_rng(7)
    for d in (1, 2, 3, 5, 17, 40):
        a = rng.normal(size=(200, d))
        if kind == "graded":
            a *= 10.0 ** rng.uniform(-6, 6, d)
        if kind == "equal":
            a = np.linalg.qr(a)[0]
        if kind == "low rank":
            a[:, d // 2:] = a[:, :1]
        if kind == "whole":
            a = np.round(a * 3) * np.where(np.arange(d) < d // 2, 1, 1000)
        r = whitening.triangle(a)
        main, upper, _ = whitening.bidiagonal(r)
        want = np.linalg.svd(a, compute_uv=False) ** 2
        assert np.allclose(whitening.squared_values(main, upper), want, rtol=1e-10, atol=1e-13 * want[0])
        axes, squares, everything = whitening.directions(r, 4)
        assert everything == pytest.approx(want.sum()) and np.allclose(axes.T @ axes, np.eye(len(squares)), atol=1e-9)
        assert np.abs(a.T @ (a @ axes) - axes * squares).max() < 1e-9 * want[0]


# --------------------------------------------------------------- quality rules
def plain_counts(text):
    """The counts of the base rules in plain Python."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i: i + 3])].append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(again))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def junk(seed, words=80):
    return prose(seed, words).replace(" ", "### ")


def test_rules_counts_equal_plain_counts(spark):
    texts = [r[1] for r in odd_rows()] + [
        "a b c a b c", "a\nb\na\n \n \na ", "x y z\u0085w\x1cq\x0bz", "one two three " * 30 + prose(8, 20),
        "\n".join(["same line here"] * 5 + ["|| other"]), "a a a a", "#*$%&|<> #", prose(9, 60) + "\n" + prose(9, 60)]
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in rows_of(rules.quality_rules(docs, labels(spark, [])))}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain_counts(t)
        assert tuple(got[i][c] for c in rules.COUNTS) == want, t
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i]["base_failed"] == failed and got[i]["kept"] == (not failed)  # without labels the base rules decide


def test_rules_on_odd_rows(spark):
    docs = clashing(documents(spark, odd_rows()))
    marks = labels(spark, [(4, 1, 0), (5, 0, 0), (5, None, 0), (None, 0, 0), (7, 0, None), (6, 1, 0)])
    got = rows_of(rules.quality_rules(docs, marks))
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["doc_id"] == 5 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    assert rules.quality_rules(documents(spark, []), marks).count() == 0
    one_class = rows_of(rules.quality_rules(docs, labels(spark, [(4, 0, 0), (6, 0, 0)])))
    assert not any(r["kept"] for r in one_class)


def test_rules_learn_and_do_not_follow_the_order_of_rows(spark):
    rows = [(i, junk(i) if i % 4 == 0 else prose(i, 80)) for i in range(400)]
    marks = labels(spark, [(i, int(i % 4 != 0), 0) for i in range(400)])
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in rows_of(rules.quality_rules(docs, marks))}
    held = [i for i in got if crc(i) % 5 == 0]
    assert len(held) > 40 and all(got[i]["kept"] == (i % 4 != 0) for i in held)
    again = {r["doc_id"]: r for r in rows_of(rules.quality_rules(docs.repartition(5, "text"), marks.repartition(3, "quality")))}
    assert again == got


def test_rules_held_out_accuracy(spark):
    docs, marks = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    got = {r.doc_id: r for r in rules.quality_rules(docs, marks).collect()}
    held = [r for r in marks.where("quality IS NOT NULL").collect() if crc(r.doc_id) % 5 == 0]
    right = [(got[r.doc_id].score >= rules.KEEP) == bool(r.quality) for r in held]
    assert len(right) > 500 and np.mean(right) > 0.95


def test_monotone_features_never_raise_a_score():
    """Labels that ask for the opposite in places are not followed against a constraint."""
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(3000, 4))
    y = (x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.3, 3000) > 0.6).astype(float)
    y[x[:, 0] > 0.8] = rng.integers(0, 2, (x[:, 0] > 0.8).sum())
    forest = rules.train(x, y, 40, monotone=np.array([1, -1, 0, 0]))
    for f, sign in ((0, 1), (1, -1)):
        for _ in range(50):
            line = np.tile(rng.uniform(size=4), (200, 1))
            line[:, f] = np.linspace(0, 1, 200)
            assert (sign * np.diff(forest.score(line)) >= -1e-12).all()
    free = rules.train(x, y, 40, monotone=np.zeros(4, int))
    assert np.mean((free.score(x) > 0.5) == y) >= np.mean((forest.score(x) > 0.5) == y) > 0.6


def test_flattened_nodes_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = rules.train(x, y, 10, monotone=np.zeros(5, int))
    got = forest.score(x)
    for row, p in zip(x, got):
        raw = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.cut[at] else forest.right[at]
            raw += forest.value[at]
        assert p == pytest.approx(1 / (1 + np.exp(-raw)))


# ----------------------------------------------------------------- prefix trie
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(x, key=lambda t: t[0])] for c, x in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * words
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p] if p in kids else 0, leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p, m in members.items())


def check_trie(df, rows):
    got = sorted((tuple(r[c] for c in prefixes.RESULT) for r in prefixes.prefix_trie(df).collect()), key=lambda r: r[:2])
    want = sorted(brute_trie(rows), key=lambda r: r[:2])
    assert got == want


def talk(rng, conv_id, vocabulary, most=6):
    return [(conv_id, t, "user" if t % 2 == 0 else "assistant", f"{rng.choice(vocabulary)}  words\tof {rng.choice('ab')}")
            for t in range(rng.randint(0, most))]


@pytest.mark.parametrize("seed, block, chunk", [(1, 20_000, 4096), (2, 3, 2), (3, 1, 1), (4, 7, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, block, chunk):
    """Blocks of a few rows cut the trie everywhere: through copies, shared heads and long paths."""
    monkeypatch.setattr(prefixes, "BLOCK_ROWS", block)
    monkeypatch.setattr(prefixes, "CHUNK", chunk)
    rng = random.Random(seed)
    rows = [r for c in range(0, 240) for r in talk(rng, c, ["x", "y"])]
    rows += [(300 + c, t, "user", "the same") for c in range(60) for t in range(4)]  # a large group of copies
    rows += [(500, t, "user", "long " * (t % 3)) for t in range(300)] + [(519, t, "user", "long " * (t % 3)) for t in range(250)]
    check_trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(5), rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (0, None, "user", "first"), (0, 0, None, None), (0, 5, "user", ""), (0, 5, "user", ""), (None, 1, "user", "lost"),
        (-20, 1, "a", "b c"), (-21, 1, "a", "b c"), (-5, 3, "1:a", "b"), (7, 1, "1", ":ab"), (8, 1, "user", " \t\n"),
        (41, 0, "user", "w " * 50_000), (42, 0, "user", "w " * 50_000), (43, 0, "é日本", "\U0001F600 ﬁ"),
        (100, 2, "user", "turn two"), (100, 1, "user", "turn one"),
    ]
    check_trie(clashing(spark.createDataFrame(rows, CONVERSATIONS)), rows)
    # An id whose turns all come from an absent conversation ends at the root.
    lone = next(c for c in range(1001, 1020) if zlib.crc32(str(c).encode()) % 4 >= 1)
    check_trie(spark.createDataFrame([(lone, 0, "user", "x")], CONVERSATIONS), [(lone, 0, "user", "x")])
    assert prefixes.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_trie_keeps_copies_of_turns(spark):
    rows = [(c, t, "user", f"{c % 3} {t}") for c in range(30) for t in range(3) for _ in range(2)]
    check_trie(spark.createDataFrame(rows, CONVERSATIONS), rows)


def test_shared_turns():
    w = prefixes.WIDTH
    rng = random.Random(5)
    for _ in range(200):
        a = b"".join(rng.choice([b"p", b"q"]) * w for _ in range(rng.randint(0, 9)))
        b = b"".join(rng.choice([b"p", b"q"]) * w for _ in range(rng.randint(0, 9)))
        want = next((i for i in range(min(len(a), len(b)) // w) if a[i * w: i * w + w] != b[i * w: i * w + w]), min(len(a), len(b)) // w)
        assert prefixes.shared_turns(a, b) == want


def test_streamed_digest_of_many_chunks(spark):
    chunks = spark.range(1000).select(F.lit(b"n").alias("name"), "id", F.col("id").cast("string").alias("ids"))
    chunks = chunks.withColumnRenamed("id", "conv_id").unionByName(
        spark.createDataFrame([(b"m", 5, "5,6"), (b"m", -3, "-3,4")], "name binary, conv_id long, ids string"))
    got = {bytes(r.name): r.streamed for r in prefixes.streamed_digests(chunks).collect()}
    want = {b"n": ",".join(map(str, range(1000))), b"m": "-3,4,5,6"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
