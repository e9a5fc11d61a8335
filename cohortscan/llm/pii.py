"""Personal data: generators propose spans, boosted trees choose, in DataFrame functions only.

Patterns with a check (octets, check digit, number of digits) give the base
spans, which always stay.  Wider generators propose further, overlapping
spans: spelled-out addresses, numbers with other signs between the digits.
Boosted trees learn from what the patterns found (1 where the check holds, 0
where it fails) which format and context make personal data, and are then
calibrated on the other half of the documents; a proposed span is added when
its probability reaches the threshold of its kind and no base span and no
likelier proposal overlaps it.

All features are small whole numbers, so the trees are fitted exactly on the
counts of feature combinations, of which there are a bounded number.

Null counts as empty text; texts without digits or signs of an address have no
spans.  Rows that repeat a document are treated alike.  Without candidates of
both classes nothing is added.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscan.llm.common import pick

KINDS = ("email", "ip", "card", "phone")
# A match starts where a run starts or the last match ended: the same matches, in linear time.
_RUN = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
_DIGIT = r"(?:\G|(?<![0-9]))"
BASE = {
    "email": _RUN + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _DIGIT + r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": _RUN + r"[A-Za-z0-9._%+-]++(?: ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]++"
                    r"|\.[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "ip": _DIGIT + r"[0-9]++(?:(?:\[\.\]|\(\.\)| ?[\[(]dot[\])] ?)[0-9]++){3}",
    "card": _DIGIT + r"[0-9]{4}[._/ -]{1,2}[0-9]{4}[._/ -]{1,2}[0-9]{4}[._/ -]{1,2}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9.+-])(?:00[1-9][0-9]{0,2}[ ./-]?)?\(?[0-9]{3}\)?[ ./-]{1,2}[0-9]{3}[ ./-][0-9]{4}(?![0-9])",
}
#: Words before a span that speak for its kind.
CUES = {
    "email": r"(?i)mail|contact|write|reach",
    "ip": r"(?i)\bip\b|address|host|server",
    "card": r"(?i)card|visa|credit|pay",
    "phone": r"(?i)phone|call|tel|fax|mobile|cell",
}
FEATURES = ("kind", "digits", "groups", "plus", "luhn", "octets", "before", "after", "cue")
CONTEXT = 24
PRECISION = 0.98


def digits_of(span: Column) -> Column:
    return F.regexp_replace(span, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits holds."""
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def octets(span: Column) -> Column:
    """Whether every part of four is at most 255."""
    parts = F.split(F.regexp_replace(span, r"[^0-9]+", "."), r"\.")
    parts = F.transform(parts, lambda p: F.regexp_replace(p, "^0+", ""))
    return (F.size(parts) == 4) & F.forall(
        parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(p != "", p.cast("int")), F.lit(0)) <= 255)
    )


def holds(kind: str, span: Column) -> Column:
    n = F.length(digits_of(span))
    return {
        "email": F.lit(True), "ip": octets(span), "phone": n.between(9, 15),
        "card": F.when(n.between(13, 19), luhn(digits_of(span))).otherwise(F.lit(False)),
    }[kind]


def found(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Matches of a pattern with start, end, text and whether the kind's check holds (null for a proposal).

    Starts follow from the lengths of the texts between the matches.
    """
    least = 12 if kind == "card" else 0  # shorter numbers are no candidates

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["span"])
        ok = holds(kind, x["span"]) if base else F.lit(None).cast("boolean")
        row = F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), x["span"].alias("span"),
            ok.alias("ok"),
        )
        kept = F.when(F.length(digits_of(x["span"])) >= least, F.concat(acc["rows"], F.array(row)))
        return F.struct(end.alias("at"), F.coalesce(kept, acc["rows"]).alias("rows"))

    pairs = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda g, m: F.struct(g.alias("gap"), m.alias("span")),
    )
    pairs = F.filter(pairs, lambda x: x["span"].isNotNull())
    row = "struct<kind:int,start:int,end:int,span:string,ok:boolean>"
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{row}>").alias("rows"))
    return F.aggregate(pairs, nothing, step)["rows"]


def candidates(text: Column) -> Column:
    """All spans of patterns and generators; patterns run only over texts that hold their signs."""
    text = F.coalesce(text, F.lit(""))
    digit = text.rlike("[0-9]")
    signs = {
        ("email", True): text.contains("@"), ("ip", True): text.rlike(r"[0-9]\.[0-9]"), ("card", True): digit,
        ("phone", True): text.contains("+"),
        ("email", False): text.rlike(r"[\[(] ?at ?[\])]| dot "), ("ip", False): digit & text.rlike(r"[0-9][ \[(]"),
        ("card", False): digit, ("phone", False): digit,
    }
    none = F.array().cast("array<struct<kind:int,start:int,end:int,span:string,ok:boolean>>")
    parts = [
        F.when(signs[kind, base], found(text, kind, (BASE if base else WIDE)[kind], base)).otherwise(none)
        for base in (True, False) for kind in KINDS
    ]
    return F.concat(*parts)


def described(text: Column, c: Column) -> dict[str, Column]:
    """Format and context of a span as small whole numbers."""
    n = F.length(digits_of(c["span"]))
    groups = F.size(F.split(c["span"], r"[^0-9]+"))
    before = F.substring(text, F.greatest(c["start"] - CONTEXT + 1, F.lit(1)), F.least(c["start"], F.lit(CONTEXT)))
    after = F.substring(text, c["end"] + 1, F.lit(1))

    def side(char):
        return F.when(char == "", 0).when(char.rlike(r"^\s"), 1).when(char.rlike(r"^[\p{L}\p{N}]"), 2).otherwise(3)

    cue = reduce(
        lambda rest, k: F.when(c["kind"] == KINDS.index(k), before.rlike(CUES[k])).otherwise(rest), KINDS, F.lit(False)
    )
    return {
        "kind": c["kind"],
        "digits": F.when(n < 3, 0).when(n < 9, 1).when(n < 10, 2).when(n < 12, 3).when(n < 13, 4).when(n < 16, 5)
        .when(n < 20, 6).otherwise(7),
        "groups": F.least(groups, F.lit(6)),
        "plus": c["span"].startswith("+").cast("int"),
        "luhn": F.when(n.between(12, 19), luhn(digits_of(c["span"])).cast("int")).otherwise(0),
        "octets": octets(c["span"]).cast("int"),
        "before": side(F.substring(before, F.length(before), F.lit(1))),
        "after": side(after),
        "cue": cue.cast("int"),
    }


@dataclass
class Trees:
    """Boosted trees of depth two: (feature, cut, (feature, cut, value, value), ...) in each round."""

    trees: list[tuple] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = (2.0,) * len(KINDS)  # above 1: nothing is added

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for f, cut, low, high in self.trees:
            for side, (g, c, a, b) in ((x[:, f] <= cut, low), (x[:, f] > cut, high)):
                out[side] += np.where(x[side, g] <= c, a, b)
        return out

    def probability(self, features: dict[str, Column]) -> Column:
        x = [features[n] for n in FEATURES]
        parts = []
        for f, cut, low, high in self.trees:
            low, high = (F.when(x[g] <= c, F.lit(a)).otherwise(F.lit(b)) for g, c, a, b in (low, high))
            parts.append(F.when(x[f] <= cut, low).otherwise(high))
        margin = reduce(lambda a, b: a + b, parts, F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-(margin * self.slope + self.shift)))


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(-g.sum() / (h.sum() + 1.0))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
    best = (0.0, 0, -1)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (low, ~low)) - g.sum() ** 2 / (h.sum() + 1)
            if gain > best[0] + 1e-9:
                best = (gain, f, int(cut))
    return best[1:]


def boost(x: np.ndarray, good: np.ndarray, bad: np.ndarray, rounds: int = 25, rate: float = 0.4) -> list[tuple]:
    """Trees over feature combinations with their counts of either class."""
    out, margin = [], np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p * (good + bad) - good, p * (1 - p) * (good + bad)
        f, cut = _split(x, g, h)
        sides = []
        for side in (x[:, f] <= cut, x[:, f] > cut):
            k, c = _split(x[side], g[side], h[side]) if side.any() else (0, -1)
            low = side & (x[:, k] <= c)
            sides.append((k, c, rate * _leaf(g[low], h[low]), rate * _leaf(g[side & ~low], h[side & ~low])))
        out.append((f, cut, *sides))
        margin += Trees([out[-1]]).margin(x)
    return out


def calibrate(model: Trees, x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> Trees:
    """Fit slope and shift of the margin, then the least probability of each kind that is precise enough."""
    m = model.margin(x)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * m + b)))
        r, w = p * (good + bad) - good, np.maximum(p * (1 - p) * (good + bad), 1e-9)
        hess = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1]])
        step = np.linalg.solve(hess, np.array([(r * m).sum() + a - 1, r.sum() + b]))
        a, b = a - step[0], b - step[1]
    p = 1 / (1 + np.exp(-(a * m + b)))
    cuts = []
    for k in range(len(KINDS)):
        own = x[:, 0] == k
        fit = [t for t in np.unique(p[own & (good > 0)])
               if good[own & (p >= t)].sum() >= PRECISION * (good + bad)[own & (p >= t)].sum()]
        cuts.append(max(0.5, float(min(fit)) - 1e-9) if fit else 2.0)
    model.slope, model.shift, model.thresholds = float(a), float(b), tuple(cuts)
    return model


def fit(documents: DataFrame) -> Trees:
    """Fit on the pattern matches of all ``documents`` (doc_id, text); even halves by a hash of the id."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.explode(candidates(F.col("text"))).alias("c"))
    rows = rows.where(F.col("c.ok").isNotNull())
    facts = described(F.col("text"), F.col("c"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")
    counts = rows.select(half, *[v.alias(k) for k, v in facts.items()], F.col("c.ok").alias("ok"))
    counts = counts.groupBy("half", *FEATURES).agg(
        F.count_if(F.col("ok")).alias("good"), F.count_if(~F.col("ok")).alias("bad")
    ).orderBy("half", *FEATURES).collect()  # one row for each combination of small numbers
    table = np.array([tuple(r) for r in counts], dtype=np.int64).reshape(len(counts), len(FEATURES) + 3)
    x, good, bad, half = table[:, 1:-2], table[:, -2].astype(float), table[:, -1].astype(float), table[:, 0]
    if not (good[half == 0].sum() and bad[half == 0].sum() and len(x[half == 1])):
        return Trees()
    model = Trees(boost(x[half == 0], good[half == 0], bad[half == 0]))
    return calibrate(model, x[half == 1], good[half == 1], bad[half == 1])


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def spans(documents: DataFrame, model: Trees, *keep: str) -> DataFrame:
    """``keep``, text, ``base`` and ``added``: arrays of (kind, start, end) in order of kind and start."""
    kept = [F.col(k) for k in keep if k != "text"]
    rows = documents.select(*kept, F.coalesce("text", F.lit("")).alias("text"), candidates(F.col("text")).alias("found"))
    base = F.filter("found", lambda c: F.coalesce(c["ok"], F.lit(False)))
    more = F.filter("found", lambda c: c["ok"].isNull())
    rows = rows.select(*[F.col(k) for k in keep if k != "text"], "text", base.alias("base"), more.alias("more"))
    limit = reduce(lambda r, k: (lambda c: F.when(c["kind"] == k, F.lit(model.thresholds[k])).otherwise(r(c))),
                   range(len(KINDS)), lambda c: F.lit(2.0))

    def rated(c):
        p = model.probability(described(F.col("text"), c))
        return F.struct(p.alias("p"), (p >= limit(c)).alias("take"), c["kind"].alias("kind"),
                        c["start"].alias("start"), c["end"].alias("end"))

    free = F.filter("more", lambda c: ~F.exists("base", lambda b: _overlap(b, c)))
    rows = rows.withColumn("more", F.filter(F.transform(free, rated), lambda c: c["take"]))
    best = F.filter("more", lambda c: ~F.exists("more", lambda d: _overlap(c, d) & (
        (d["p"] > c["p"]) | ((d["p"] == c["p"]) & (F.struct(d["kind"], d["start"]) < F.struct(c["kind"], c["start"])))
    )))

    def ordered(column):
        return F.array_sort(F.transform(column, lambda c: F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))

    return rows.select(*[F.col(k) for k in keep if k != "text"], "text", ordered("base").alias("base"), ordered(best).alias("added"))


def written(column: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(documents: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    documents = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = spans(documents, fit(documents), "doc_id")
    every = F.array_sort(F.concat("base", "added"))
    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return got.select(
        "doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(every).alias("spans"),
    )


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; ``n_chars`` follows the text."""
    names = ("doc_id", "text", "lang", "source", "n_chars")
    documents = pick(documents, *names)
    got = spans(documents, fit(documents), *names, )
    null = documents.select(*names).schema["n_chars"].dataType.simpleString()
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def step(acc, s):
        inside = s["start"] < acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]),
                         F.element_at(marks, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], -s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(piece).alias("out"))

    done = F.aggregate(every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rows = got.withColumn("done", F.when(F.size(every) > 0, done))
    text = F.when(F.col("done").isNull(), F.col("text")).otherwise(
        F.concat("done.out", F.substring("text", F.col("done.at") + 1, F.length("text"))))
    rows = rows.withColumn("text", text)
    n = F.when(F.col("done").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(null))
    return rows.withColumn("n_chars", n).select(*names)
