"""Pieces, personal data and fingerprints against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from array import array

import public_tokenizers
import pytest

from cohortscan.llm import pieces, pii, simhash
from cohortscan.llm.common import table
from tests.llm.helpers import clashing, documents, odd_rows, prose, rows_of

SMALL = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.model_bytes(MODEL))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_pieces_equal_library(spark, vocabulary):
    docs = table(spark, SMALL, "documents")
    got = {r["doc_id"]: r for r in rows_of(pieces.round_trip(docs, MODEL))}
    lib = vocabulary.library
    for r in docs.select("doc_id", "text").collect():
        ids = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == sha(array("I", ids).tobytes())
        assert own["decoded_sha256"] == sha(lib.decode(ids).encode())


def test_pieces_of_random_text(vocabulary):
    rng = random.Random(5)
    signs = "ab e\n\t  ▁▁  .,()é́日本\U0001F600\x00﻿　ＡﬁЖß0123<s>eeeenn\r\xa0»’"
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000)]
    texts += ["", "a" * 5000, " " * 1000, "ab" * 3000, "\n", "▁", " \n ", "<0x41>", "</s>"]
    for text, ids in zip(texts, vocabulary.encode_batch(texts)):
        expected = vocabulary.library.encode(text, add_bos=True, add_eos=True)
        assert list(array("I", ids)) == expected, text
        assert vocabulary.decode(ids) == vocabulary.library.decode(expected)


def test_pieces_edge_cases(spark):
    odd = clashing(documents(spark, odd_rows()))
    rows = rows_of(pieces.round_trip(odd, MODEL))
    assert len(rows) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["n_tokens"] == 2 and by_id[1]["decoded_sha256"] == sha(b"") and by_id[1]["ids_sha256"] == by_id[2]["ids_sha256"]
    assert pieces.round_trip(odd.limit(0), MODEL).count() == 0


def test_pieces_disagreement_is_an_error(vocabulary, monkeypatch):
    fresh = pieces.Vocabulary(pieces.model_bytes(MODEL))
    monkeypatch.setattr(fresh, "agenda", lambda s: [0])
    with pytest.raises(AssertionError, match="differently"):
        fresh.encode_batch(["hello world"])


PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text: str) -> list[str]:
    def holds(kind, m):
        digits = re.sub(r"[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and plain_luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in p.finditer(text) if holds(k, m.group())]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(9)
    signs = ["a", "b@c.d", "@", ".", "..", "1", "23", "4111111111111111", "+1", "-", " ", "(", ")", "255", "256", "é", "x.y_z@e.f", "\n", "007"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(600)]
    texts += [None, "", "4111 1111-1111 1111 and 4111111111111112", "1.2.3.4.5.6.7.8", "1.2.3", "+12345678", "+1 (017) 555-7713%%%",
              "a@b.c_d@e.f", "a@b.c@d.e.f", "1 " * 20_000, "9" * 20_000, "é😀 a.b@c.de 😀 10.0.0.1"]
    docs = documents(spark, list(enumerate(texts)))
    for r in rows_of(pii.personal_data(docs)):
        base = plain_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == sha(",".join(base).encode()), texts[r["doc_id"]]
        assert set(base) <= set(filter(None, r["spans"].split(",")))
        for k in PLAIN:
            assert r[f"n_{k}"] == sum(s.startswith(k) for s in base)


def test_base_spans_of_the_documents(spark):
    docs = table(spark, SMALL, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = rows_of(pii.personal_data(docs))
    assert all(r["base_sha256"] == sha(",".join(plain_spans(texts[r["doc_id"]] or "")).encode()) for r in rows)


def test_trees_add_spelled_out_spans(spark):
    """Proposals that look like what the patterns accept are added, others are not."""
    good = [f"call me at +1 (21{i % 10}) 555-{1000 + i} or write to user{i}@mail.example.com now" for i in range(60)]
    bad = [f"order {10 + i}.{300 + i}.{i}.{i} of item 41111111111111{10 + i} at +1234{i % 10}56 end" for i in range(60)]
    asked = "please call 212 555-1234 today or write to jane (at) example.com soon"
    docs = documents(spark, list(enumerate(good + bad + [asked])))
    model = pii.fit(docs)
    assert model.trees and all(0 < s for s in model.thresholds)
    rows = {r["doc_id"]: r for r in rows_of(pii.personal_data(docs))}
    at = asked.index("jane")
    assert f"email:{at}:{asked.index(' soon')}" in rows[120]["spans"]
    assert rows[0]["spans"].count("phone") == 1 and rows[60]["spans"] == ""


def test_redaction(spark):
    text = "é write a.b@c.de or +1 (212) 555-1234, host 10.0.0.1."
    docs = clashing(documents(spark, [(1, text, "en", "s"), (2, None), (3, "nothing here", "en", "s")]))
    rows = {r["doc_id"]: r for r in rows_of(pii.redacted(docs))}
    assert rows[1]["text"] == "é write [EMAIL] or [PHONE], host [IP]." and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[3]["text"] == "nothing here" and rows[2]["n_chars"] is None


def test_personal_data_edge_cases(spark):
    odd = clashing(documents(spark, odd_rows()))
    rows = rows_of(pii.personal_data(odd))
    assert len(rows) == len(odd_rows()) and all(r["spans"] == "" for r in rows)
    assert pii.personal_data(odd.limit(0)).count() == 0 and pii.redacted(odd.limit(0)).count() == 0


def plain_fingerprint(text: str) -> int:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    words = re.findall(r"[^\W_]+", text.lower())
    if not words:
        return 0
    rows = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) a", "xxhash64('second', w) b").collect()
    votes, total = [0] * 128, 0
    for w, a, b in rows:
        weight = 1 if len(w) <= 3 else min(2 * (len(w) - 3), 24)
        total += weight
        number = ((a & (2**64 - 1)) << 64) | (b & (2**64 - 1))
        for i in range(128):
            votes[i] += weight * (number >> i & 1)
    return sum(1 << i for i in range(128) if 2 * votes[i] > total)


def test_fingerprints_and_edited_texts(spark):
    rows = [(i * 3, prose(i % 17, 5 + 7 * (i % 9))) for i in range(60)]
    rows += [(r[0] + 1000, *r[1:]) for r in odd_rows() if r[0] is not None]
    docs = clashing(documents(spark, rows))
    got = sorted(rows_of(simhash.edited_fingerprints(docs)), key=lambda r: (r["doc_id"], r["n_chars"]))
    plain = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in plain]
    assert [r["doc_id"] for r in got] == [i for i, _ in plain]
    numbers = [int(r["fingerprint"], 16) for r in got]
    for k, (r, text) in enumerate(zip(got, texts)):
        half, following = len(text) // 2, texts[(k + 1) % len(texts)]
        edit = text[: len(text) - half] + following[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == sha(edit.encode())
        if k % 7 == 0 and len(text) < 2000:
            assert numbers[k] == plain_fingerprint(text)
            assert int(r["edited_fingerprint"], 16) == plain_fingerprint(edit)
        assert r["near_next"] == 1 - (numbers[k] ^ numbers[(k + 1) % len(texts)]).bit_count() / 128
        near = sum((numbers[k] ^ n).bit_count() <= simhash.RADIUS for n in numbers)
        assert r["near_found"] == (near if r["doc_id"] % 100 == 0 else None)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1001, 1002)}) == 1


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_block_tables_find_all(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(20)]
    numbers = sorted({b ^ sum(1 << i for i in rng.sample(range(128), rng.randrange(9))) for b in base for _ in range(12)})
    signed = [(n >> 64, n & (2**64 - 1)) for n in numbers]
    signed = [tuple(x - 2**64 if x >= 2**63 else x for x in p) for p in signed]
    prints = spark.createDataFrame([(*p, 1) for p in signed], "high long, low long, n int")
    found = [tuple(r)[:4] for r in simhash.near(prints.limit(100), prints, radius).collect()]
    asked = [tuple(r)[:2] for r in prints.limit(100).collect()]
    number = dict(zip(signed, numbers))
    expected = {(*a, *b) for a in asked for b in signed if (number[a] ^ number[b]).bit_count() <= radius}
    assert len(found) == len(set(found)) and set(found) == expected


def test_block_tables_find_all_at_the_radius_of_near_copies(spark):
    rng = random.Random(8)
    assert simhash.RADIUS > 7
    base = [rng.getrandbits(128) for _ in range(20)]
    numbers = sorted({b ^ sum(1 << i for i in rng.sample(range(128), rng.randrange(20))) for b in base for _ in range(12)})
    signed = [tuple(x - 2**64 if x >= 2**63 else x for x in (n >> 64, n & (2**64 - 1))) for n in numbers]
    prints = spark.createDataFrame([(*p, 1) for p in signed], "high long, low long, n int")
    for radius in (8, simhash.RADIUS):
        found = [tuple(r)[:4] for r in simhash.near(prints, prints, radius).collect()]
        expected = {(*a, *b) for a, x in zip(signed, numbers) for b, y in zip(signed, numbers) if (x ^ y).bit_count() <= radius}
        assert len(found) == len(set(found)) and set(found) == expected


def test_near_copies_are_found_and_named(spark):
    """Texts of 300 words with two words changed: most lie beyond 3 bits, and rows name the id that finds them."""
    rows = []
    for k in range(12):
        words = prose(900 + k, 300).split()
        rows.append((100 * k, " ".join(words)))
        for i in range(1, 8):
            words[17 * i], words[40 * i] = f"changed{i}", f"other{k}x{i}"
            rows.append((100 * k + i, " ".join(words[: 17 * i + 1] + rows[-i][1].split()[17 * i + 1:])))
    got = {r["doc_id"]: r for r in rows_of(simhash.edited_fingerprints(documents(spark, rows)))}
    number = {i: int(r["fingerprint"], 16) for i, r in got.items()}
    asked = [i for i in number if i % 100 == 0]
    for i, r in got.items():
        finders = [q for q in asked if (number[q] ^ number[i]).bit_count() <= simhash.RADIUS]
        assert r["near_class"] == min(finders, default=None)
    named = [i for i in number if i % 100 and got[i]["near_class"] == i - i % 100]
    assert len(named) > 0.8 * 84


def test_fingerprints_of_no_rows(spark):
    empty = documents(spark, [])
    assert simhash.edited_fingerprints(empty).count() == 0
    one = rows_of(simhash.edited_fingerprints(documents(spark, [(100, "ab cd")])))
    assert one[0]["near_next"] == 1.0 and one[0]["near_found"] == 1
