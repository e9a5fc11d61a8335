"""Urls, mixing, near-duplicates, neighbours and the pipeline against plain versions."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from cohortscan.llm import jaccard, mixing, nearest, pieces, quality, queries, urls
from cohortscan.llm.common import table
from tests.compare import compare
from tests.llm.helpers import clashing, documents, odd_rows, prose, rows_of

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, SMALL, queries.QUERIES[name], queries.ORACLES[name]) is None


def plain_verdict(url, entries):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    hits = []
    for e in entries:
        h, _, p = e.pattern.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            hits.append((e.kind == "rule", len(e.pattern), e.verdict == "block", e))
    best = max(hits, key=lambda x: x[:3])[3] if hits else None
    return host, path, best.pattern if best and best.kind == "rule" else None, best.verdict if best else "allow"


def test_urls_equal_plain_rules(spark):
    rng = random.Random(2)
    entries = urls.RULES + urls.LISTED + [urls.Entry("bad.net/", "block"), urls.Entry("bad.net/ok/", "allow"), urls.Entry("x/", "block", "list")]
    hosts = ["example.org", "EXAMPLE.org", "www.example.org", "notexample.org", "org", "a.com", "x.bad.net", "bad.net", "casino-win.example.com", "m.casino-win.example.com", "x", "é.X", ""]
    paths = ["", "/", "/es/1", "/en/17", "/en/2", "/fr/", "/de/a/b", "/ok/z", "/es", "//en/1"]
    rows = [None, "", "no scheme", "http://", "http:///fr/", "a://b://c.com/fr/", "http://a.com\n/fr/", "http://" + "y." * 5000 + "bad.net/" + "z" * 50_000]
    rows += [f"{rng.choice(['http', 'https', ''])}://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=://x.org/", "#/fr/")]
    df = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(rows + rows[:5])], "page_id long, url string"))
    for r in rows_of(urls.judge(df, entries)):
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict((rows + rows[:5])[r["page_id"]], entries)
    assert urls.judge(df.limit(0), entries).count() == 0
    assert {r["verdict"] for r in urls.judge(df, []).collect()} == {"allow"}


def test_digest_collisions_are_told_apart(spark, tmp_path):
    """Keys with one digest stand side by side and are confirmed by their strings."""
    index = urls.Index.__new__(urls.Index)
    index.digests = np.array([5, 7, 7, 7, 9], np.uint64)
    strings = [b"a", b"b", b"cc", b"d", b"e"]
    index.starts = np.cumsum([0, *map(len, strings)]).astype(np.uint64)
    index.strings = np.frombuffer(b"".join(strings), np.uint8)
    index.codes = np.zeros(5, np.uint8)
    got = index.probe(np.array([7, 7, 7, 9, 1, 11], np.uint64), ["d", "cc", "no", "e", "a", "e"])
    assert got.tolist() == [3, 2, -1, 4, -1, -1]


def test_spark_and_library_digests_agree(spark):
    texts = ["", "org/", "é日本", "x" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) h").collect()
    assert all(r["h"] & (2**64 - 1) == xxhash.xxh64_intdigest(r["t"].encode(), urls.SEED) for r in rows)


def test_targets_reshare_the_excess():
    got = mixing.targets([100, 100, 1000], [5, 2, 1])
    assert got == [200, 200, 1400] and mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 1]) == [0, 0]
    assert mixing.targets([10, 10], [1, 1], budget=3.0) == [20, 20]


def plain_cost(patterns, wanted, repeats):
    """Least cost by trying every whole flow of a small network."""
    names = sorted(wanted)
    options = []
    for members, size in patterns:
        own = [n for n in names if n in members]
        options.append([c for c in itertools.product(range(repeats * size + 1), repeat=len(own)) if sum(c) <= repeats * size])
    best = (-1, 0)
    for choice in itertools.product(*options):
        sent, cost = dict.fromkeys(names, 0), 0
        for (members, size), c in zip(patterns, choice):
            for n, x in zip([n for n in names if n in members], c):
                sent[n] += x
            cost += sum(max(0, min(size, sum(c) - r * size)) * r for r in range(repeats))
        if all(sent[n] <= wanted[n] for n in names):
            best = max(best, (sum(sent.values()), -cost))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_cheapest(seed):
    rng = random.Random(seed)
    patterns = [(frozenset(m), rng.randrange(1, 4)) for m in (["a"], ["b"], ["a", "b"])]
    wanted = {"a": rng.randrange(1, 7), "b": rng.randrange(1, 7)}
    routed = mixing.quotas(patterns, wanted, 2)
    total = sum(sum(r.values()) for r in routed.values())
    cost = sum(max(0, sum(routed[m].values()) - size) for m, size in patterns)
    assert (round(total), -round(cost)) == plain_cost(patterns, wanted, 2)


def test_mix_of_documents(spark):
    rows = [(i, prose(i, 3 + i % 40), "en", [None, "b", "a", "c"][0 if i % 20 == 0 else 1 + i % 3]) for i in range(900)]
    docs = clashing(documents(spark, rows))
    got = rows_of(mixing.mixed_sources(docs))
    again = rows_of(mixing.mixed_sources(docs.repartition(7)))
    key = lambda r: r["doc_id"]
    assert sorted(got, key=key) == sorted(again, key=key)
    source = {r[0]: r[3] for r in rows}
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in ("a", "b", "c", None)}
    wanted = dict(zip(("a", "b", "c", None), mixing.targets(list(sizes.values()), [5, 2, 1, 5])))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["source_size"] == sizes[s]
        assert abs(r["target"] - wanted[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 0.01 * wanted[s] + 2 for s in sizes)
    corpus = mixing.mixed_corpus(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in corpus} == {r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]}


def test_mix_of_overlapping_sources(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, [(i, "w " * 10, None, ["a", "b", "a b"][i % 3]) for i in range(300)])
    mixed = mixing.mix(docs, F.split("source", " "))
    assert mixed.sizes == {"a": 2000, "b": 2000}
    got = {r["pattern"]: r["w"] for r in mixed.rows.groupBy("pattern").agg(F.sum(F.col("size") * F.col("copies")).alias("w")).collect()}
    assert abs(sum(got.values()) - sum(mixed.wanted.values())) <= 30 or sum(got.values()) == 6000


def test_mix_edge_cases(spark):
    odd = clashing(documents(spark, odd_rows()))
    rows = rows_of(mixing.mixed_sources(odd))
    assert len(rows) == len(odd_rows()) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mixed_sources(odd.limit(0)).count() == 0 and mixing.mixed_corpus(odd.limit(0)).count() == 0


def plain_shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(" ".join(w[i: i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def plain_classes(rows):
    sets = [plain_shingles(r[1]) for r in rows]
    label, links = list(range(len(rows))), [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    least = {}
    for x, r in zip(label, rows):
        least[x] = min(least.get(x, r[0]), r[0])
    return {(r[0], least[x], n) for r, x, n in zip(rows, label, links)}


def changed(text, words, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(words):
        w[rng.randrange(len(w))] = f"other{rng.randrange(1000)}"
    return " ".join(w)


def test_jaccard_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 16)  # groups of several blocks
    rows, base = [], [prose(i, 70) for i in range(12)]
    for i in range(220):
        text = base[i % 12] if i % 3 else changed(base[i % 12], i % 5, i)
        rows.append((i * 2, changed(base[0], 1 + i % 2, i) if i % 4 == 0 else text))
    rows += [(1001, None), (1003, ""), (1005, "one two"), (1007, "One, two!"), (1009, "..."), (1011, prose(99, 20_000))]
    rows += rows[:3]
    docs = clashing(documents(spark, rows))
    got = jaccard.jaccard_join(docs).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == plain_classes(rows)
    kept = [r["doc_id"] for r in jaccard.one_of_each(docs).collect()]
    assert sorted(kept) == sorted({c for _, c, _ in plain_classes(rows)})


def test_jaccard_edge_cases(spark):
    odd = clashing(documents(spark, odd_rows()))
    assert jaccard.jaccard_join(odd).count() == len(odd_rows())
    assert jaccard.jaccard_join(odd.limit(0)).count() == 0 and jaccard.one_of_each(odd.limit(0)).count() == 0
    assert jaccard.prefix_depth(recall=0.9) > jaccard.prefix_depth(recall=0.999999) >= 1


def test_forest_prefixes(spark):
    """Neighbours in a sorted trie tell for every set the longest prefix that it shares with any other."""
    rng = random.Random(8)
    cut = [jaccard.cut_bits(d) for d in range(jaccard.DEPTH + 1)]

    def key():
        return sum(rng.randrange(3) << c for c in cut[1:])

    rows = [(i, [key() for _ in range(jaccard.TREES)]) for i in range(150)]
    sets = spark.createDataFrame(rows, "node long, keys array<long>").repartition(3)
    got = {(r["node"], r["tree"]): (r["key"], r["reach"]) for r in jaccard.company(sets, 2).collect()}
    wanted = {}
    for t in range(jaccard.TREES):
        for i, own in rows:
            reach = max(sum(own[t] >> c == k[t] >> c for c in cut[1:]) for j, k in rows if j != i)
            if reach >= 2:
                wanted[i, t] = (own[t], reach)
    assert got == wanted and len({r for _, r in got.values()}) > 3
    assert jaccard.company(sets.limit(0), 2).count() == 0

    flat, sizes = jaccard.shingles([prose(1, 300), changed(prose(1, 300), 2, 1), None, prose(2, 300)])
    keys = jaccard.signature_keys(flat, sizes)
    assert keys.shape == (4, jaccard.TREES) and not keys[2].any() and int(keys.max()) < 1 << jaccard.cut_bits(0)
    shared = [(keys[0] >> np.uint64(c) == keys[1] >> np.uint64(c)).sum() for c in cut]
    assert shared == sorted(shared, reverse=True) and shared[jaccard.DEPTH] and not (keys[0] == keys[3]).any()


def test_forest_shortens_prefixes_until_the_recall(spark, monkeypatch):
    """Many links far above the threshold end at whole signatures, links at the threshold need shorter prefixes."""
    depths, reached = [], []
    at = jaccard.links_at
    monkeypatch.setattr(jaccard, "links_at", lambda held, met, depth: depths.append(depth) or at(held, met, depth))
    for words, edits in ((400, 1), (100, 2)):
        rows = [(i, changed(prose(i % 3, words), edits, i)) for i in range(60)]
        docs = documents(spark, rows)
        assert {tuple(r) for r in jaccard.jaccard_join(docs).collect()} == plain_classes(rows)
        sets = {frozenset(plain_shingles(t)) for _, t in rows}
        similar = [len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2)]
        held = [0.8] + [j for j in similar if j >= 0.8]
        lost = {d: sum((1 - j**d) ** jaccard.TREES / (1 - (1 - j**d) ** jaccard.TREES) for j in held) for d in range(1, 7)}
        last = next(d for d in range(6, 0, -1) if len(held) / (len(held) + lost[d]) >= jaccard.RECALL)
        assert depths == list(range(6, last - 1, -1))
        reached.append(last)
        depths.clear()
    assert reached[0] > reached[1]
    floor = jaccard.prefix_depth()
    told = np.concatenate(([1.0], jaccard.unseen([0.8])[0]))
    assert jaccard.recall_of(told, floor) >= jaccard.RECALL > jaccard.recall_of(told, floor + 1)


def test_large_buckets_are_parted(spark, monkeypatch):
    """A group of near copies keeps all links, and its blocks grow less than those of whole buckets."""
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rows = [(i, changed(prose(5, 300), 1 + i % 4, i)) for i in range(200)]
    seen, parted = [], jaccard.blocks

    def counted(met, depth):
        out = parted(met, depth)
        whole = met.agg({"members": "sum"}).first()[0] or 0  # one row for each member and member of its bucket
        seen.append((out.count() * jaccard.CHUNK, whole))
        return out

    monkeypatch.setattr(jaccard, "blocks", counted)
    assert {tuple(r) for r in jaccard.jaccard_join(documents(spark, rows)).collect()} == plain_classes(rows)
    assert sum(a for a, _ in seen) < 0.7 * sum(b for _, b in seen)


def test_crowds_are_compared_once(spark, monkeypatch):
    """The trees join and deal no rows of a group of near copies again, and sets beside it keep their links to it."""
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rows = [(i, changed(prose(5, 300), 1 + i % 4, i)) for i in range(120)]
    rows += [(200 + i, changed(prose(5, 300), 12 + i % 5, i)) for i in range(30)]
    rows += [(300 + i, changed(prose(6 + i % 4, 300), i % 3, i)) for i in range(24)]
    seen, found = [], jaccard.buckets

    def counted(met, depth):
        out = found(met, depth)
        seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "buckets", counted)
    assert {tuple(r) for r in jaccard.jaccard_join(documents(spark, rows)).collect()} == plain_classes(rows)
    assert seen and sum(seen) < 24 * 120


def test_chains_of_buckets_are_no_crowd(spark, monkeypatch):
    """Buckets with one set in common stay apart where all pairs of the chain would be more than their own."""
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    key = lambda i: 0 if i < 10 else 1 << jaccard.cut_bits(1)
    chain = [(i, t, key(i) if t < 2 else 7) for i in range(20) for t in range(2)] + [(9, 2, 5), *[(i, 2, 5) for i in range(10, 13)]]
    met = spark.createDataFrame(chain, "node long, tree int, key long")
    got = {(r["node"], r["crowd"], r["members"]) for r in jaccard.crowds(met, 4).collect()}
    assert got == {(i, 0, 20) for i in range(20)}  # two trees of two buckets hold as many pairs as all 20 sets
    once = met.where("tree != 1")
    assert jaccard.crowds(once, 4).count() == 0 and jaccard.crowds(once.limit(2), 4) is None


def test_null_ids_and_texts_that_share_an_id(spark):
    """Null-id rows link, survive and are mixed; of near copies under one id a single one survives."""
    a, b, c, d = (prose(200 + i, 80) for i in range(4))
    rows = [(None, a), (None, a + " more"), (None, b), (7, b + " more"), (3, c), (3, c + " more"), (3, d), (None, None), (None, "")]
    docs = clashing(documents(spark, [(*r, "en", "a") for r in rows]))
    got = sorted((tuple(r) for r in jaccard.jaccard_join(docs).collect()), key=str)
    assert got == sorted([(None, None, 1)] * 2 + [(None, 7, 1), (7, 7, 1), (3, 3, 1), (3, 3, 1), (3, 3, 0)] + [(None, None, 0)] * 2, key=str)
    single = jaccard.one_of_each(docs)
    kept = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert len(kept) == 6 and {(7, b + " more"), (3, d), (None, None), (None, "")} <= set(kept)
    assert sum(k in ((None, a), (None, a + " more")) for k in kept) == 1
    assert sum(k in ((3, c), (3, c + " more")) for k in kept) == 1

    many = documents(spark, [(None if i % 2 else i // 4, prose(i, 20), "en", "ab"[i % 3 % 2]) for i in range(400)])
    sizes = [r["taken"] // r["size"] for r in mixing.mixed_sources(many).collect()]
    corpus = mixing.mixed_corpus(many).collect()
    assert len(corpus) == sum(sizes) and 150 < sum(r["doc_id"] is None for r in corpus) < 450
    wanted = {r["pattern"]: r["w"] for r in mixing.mix(many, mixing.F.array("source")).rows.groupBy("pattern").agg(
        mixing.F.sum(mixing.F.col("size") * mixing.F.col("copies")).alias("w")).collect()}
    goals = mixing.mix(many, mixing.F.array("source")).wanted
    assert all(abs(wanted["+" + s] - w) <= 20 for s, w in goals.items())


def test_components(spark):
    rng = random.Random(4)
    edges = [(a, b) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(120)) if a > b] + [(i + 1, i) for i in range(300, 340)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {n: r for n, r in label.items() if n != r}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_recall(spark):
    got = {}
    for r in rows_of(nearest.search(table(spark, "/root/testdata/sf0.1", "embeddings"))):
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q][0]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        own = [got[q][i + 1] for i in range(20)]
        score = dict(zip(ids, s))
        assert all(score[i] == v for i, v in own) and own == sorted(own, key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in own} & set(ids[order]))
        total += 20
    assert hits / total >= 0.9


def test_neighbours_in_several_blocks(spark, monkeypatch):
    """Clustered vectors of different lengths: windows are small and recall holds."""
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(nearest, "QUERIES", 16)
    monkeypatch.setattr(nearest, "FAN", 2)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(50, 16)) * 0.2 for c in centres]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = rows_of(nearest.search(vectors(spark, rows), every=20, k=5))
    x = x.astype(float)
    hits = 0
    for q in range(0, 2000, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-s)[:5]))
    assert hits >= 0.9 * 5 * 100


def test_neighbour_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (21, [1.0, 0.0], 1), (22, [0.0, 2.0], 1), (22, [0.0, 2.0], 1),
            (40, None, 1), (60, [0.0, 0.0], 1), (80, [nan, 1.0], 1), (100, [inf, 1.0], 1), (120, [None, 1.0], 1), (140, [1.0], 1),
            (160, [], 1), (None, [1.0, 1.0], 1)]
    df = clashing(vectors(spark, rows))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows_of(nearest.search(df))}
    assert got == {(0, 1): (20, 1.0), (0, 2): (21, 1.0), (0, 3): (22, 0.0), (20, 1): (0, 1.0), (20, 2): (21, 1.0), (20, 3): (22, 0.0)}
    assert nearest.search(df.limit(0)).count() == 0 and nearest.search(df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_to_neighbours(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = nearest.hilbert(points, bits)
    walk = points[np.argsort(place)]
    assert sorted(place) == list(range(len(points))) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version of its decision, on what its predecessor kept."""
    docs = table(spark, TINY, "documents")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, TINY).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(rows_of(docs))
    columns = {"doc_id", "text", "lang", "source", "n_chars"}
    assert all(set(k[0]) == columns for k in kept[:4])
    good, single, safe, mixed, coded = kept
    judged = quality.quality(table(spark, TINY, "documents"), table(spark, TINY, "labels"))
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r in judged.collect() if r["predicted"])
    classes = plain_classes([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, c, _ in classes})
    assert len(safe) == len(single) and not any(re.search(r"[\w.]+@\w+\.\w+|\d+\.\d+\.\d+\.\d+", r["text"]) for r in safe)
    texts = {r["doc_id"]: r["text"] for r in safe}
    assert all(texts[r["doc_id"]] == r["text"] for r in mixed)
    lib = pieces.Vocabulary(pieces.model_bytes(queries.piece_model())).library
    assert sorted((r["doc_id"], r["n_tokens"]) for r in coded) == sorted(
        (r["doc_id"], len(lib.encode(r["text"])) + 2) for r in mixed)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, TINY).count() > 0
