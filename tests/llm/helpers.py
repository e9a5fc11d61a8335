"""Small tables with the cases that every operator must bear."""

from __future__ import annotations

import random
import zlib

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with given ones or with names that operators use themselves.
CLASHING = "TEXT string, score double, pattern string, place long, node long, part int, kind int, found string"


def prose(seed: int, words: int, alphabet: str = "aeioulmnrst") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 9))) for _ in range(words)).capitalize() + "."


def documents(spark, rows):
    """``rows`` of (doc_id, text[, lang[, source]])."""
    full = [(*r, *([None] * (4 - len(r))), len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def clashing(df):
    extra = ", ".join(f"CAST(NULL AS {t}) AS `{n}`" for n, t in (c.split() for c in CLASHING.split(", ")))
    view = df.selectExpr(*[c for c in df.columns if c not in CLASHING])
    return view.selectExpr("*", *extra.split(", ")) if extra else view


def odd_rows():
    """Null, empty and blank texts, a very long one, a repeated row, a repeated text, a null id."""
    long_text = prose(1, 30_000)
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, long_text, "en", "a"),
        (5, prose(2, 80), "de", "b"), (5, prose(2, 80), "de", "b"), (6, prose(2, 80), None, "b"),
        (7, "x" * 50_000, "en", "c"), (8, "1 2 3", "en", "c"), (9, "é日本 \U0001F600 ﬁ", "fr", None),
        (None, prose(3, 40), "en", "c"),
    ]


def crc(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def rows_of(df):
    return [r.asDict() for r in df.collect()]
