"""Document fingerprints by SimHash, in DataFrame functions only.

The words of a whole text (lower-cased runs of letters and digits) vote on 128
bits with their hashes; a word's weight grows with its length, so that the
short words that all texts share decide little.  A bit is set if more than
half of the weight votes for it.  Two bit counts travel in the halves of one
long, which adds up without carry for any text that a column can hold.

All fingerprints within a Hamming radius are found through tables that each
put another block of the bits first: two such fingerprints differ in some block
by no more than the radius divided by the number of blocks.  Above a radius of
7 that is one bit, and a query looks up its block and those one bit away.  A
pair counts in the first table that holds it.

Null counts as empty text; a text without words has the fingerprint 0.  Equal
texts have equal fingerprints.  Rows that repeat an id are told apart by their
place in the order of id and text; null ids come first.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscan.llm.common import pick
from cohortscan.session import checkpointed

#: Two counts of 32 bits in a long.
LANES = (1 << 32) | 1
LOW = (1 << 32) - 1
BITS = 128
RADIUS = 15


def weight(word: Column) -> Column:
    n = F.length(word)
    return F.when(n == 0, 0).when(n <= 3, 1).otherwise(F.least(2 * (n - 3), F.lit(24))).cast("long")


def _packed(counts: list[Column], total: Column) -> Column:
    """64 bits from 32 pairs of counts."""
    bits = []
    for i, c in enumerate(counts):
        bits.append(F.when(2 * c.bitwiseAND(LOW) > total, F.lit(1 << i)).otherwise(F.lit(0)))
        high = 1 << (i + 32) if i < 31 else -(1 << 63)
        bits.append(F.when(2 * F.shiftrightunsigned(c, 32) > total, F.lit(high)).otherwise(F.lit(0)))
    return reduce(lambda a, b: a.bitwiseOR(b), [b.cast("long") for b in bits])


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``high`` and ``low`` (the fingerprint) of each row of ``texts``; keys are distinct."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    votes = texts.select(*keys, F.explode(words).alias("word")).select(
        *keys, weight(F.col("word")).alias("w"), F.xxhash64("word").alias("h0"),
        F.xxhash64(F.lit("second"), "word").alias("h1"),
    )
    sums = [
        F.sum(F.col("w") * F.shiftrightunsigned(f"h{k}", i).bitwiseAND(LANES)).alias(f"s{k}_{i}")
        for k in (0, 1) for i in range(32)
    ]
    counted = votes.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)
    high, low = (_packed([F.col(f"s{k}_{i}") for i in range(32)], F.col("total")) for k in (0, 1))
    return counted.select(*keys, high.alias("high"), low.alias("low"))


def as_text(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits."""
    return 1.0 - distance(a, b) / F.lit(float(BITS))


def blocks_of(high: Column, low: Column, blocks: int) -> list[Column]:
    size = BITS // blocks
    mask = (1 << size) - 1
    return [
        F.shiftrightunsigned(half, shift).bitwiseAND(mask)
        for half in (high, low) for shift in range(0, 64, size)
    ]


def near(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (q_high, q_low, high, low, n) of ``queries`` with all of ``prints`` (high, low, n) within ``radius``.

    Both sides hold distinct fingerprints; a fingerprint is its own partner.
    Further columns of ``queries`` come along.
    """
    if not 0 <= radius < 16:
        raise ValueError("a radius is 0 to 15")
    # Wide blocks keep the tables selective; blocks of 8 bits would meet a sixteenth of all rows.
    blocks = 4 if radius < 4 else 8
    apart_in_block = radius // blocks
    flips = [0] + [1 << i for i in range(BITS // blocks)] * apart_in_block

    def tables(df, high, low, flips):
        keyed = [F.struct(F.lit(t).alias("t"), b.bitwiseXOR(F.lit(x).cast("long")).alias("block"))
                 for t, b in enumerate(blocks_of(F.col(high), F.col(low), blocks)) for x in flips]
        return df.withColumn("_key", F.explode(F.array(*keyed))).select("*", "_key.t", "_key.block").drop("_key")

    left = queries.select(F.col("high").alias("q_high"), F.col("low").alias("q_low"), *queries.drop("high", "low", "n").columns)
    asked = left.columns
    left = tables(left, "q_high", "q_low", flips)
    right = tables(prints, "high", "low", [0])
    apart = distance((F.col("q_high"), F.col("q_low")), (F.col("high"), F.col("low")))
    differ = blocks_of(F.col("q_high").bitwiseXOR(F.col("high")), F.col("q_low").bitwiseXOR(F.col("low")), blocks)
    first = reduce(lambda a, b: a & b, [(F.col("t") <= i) | (F.bit_count(d) > apart_in_block) for i, d in enumerate(differ)])
    found = left.join(right, ["t", "block"]).where((apart <= radius) & first)
    return found.select(*asked, "high", "low", "n")


def in_order(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) with the text that follows in the order of ids, the first one after the last.

    Rows are dealt out by ranges of ids.  The first rows of a range are also
    sent to the range before it, where they follow its last row; so every text
    moves about once, whatever the number of rows.  (part, nr) is a key of a
    row, (next_part, next_nr) that of the row that follows.
    """
    spark = documents.sparkSession
    # Several ranges for each partition, so that the hash of the ranges fills partitions evenly.
    parts = 4 * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranks = ", ".join(str(i / parts) for i in range(1, parts))
    got = documents.agg(
        F.expr(f"percentile_approx(doc_id, array({ranks}), {max(10_000, 10 * parts)})").alias("cuts"),
        F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"),
    ).first()
    starts = sorted({c for c in got["cuts"] or [] if got["nulls"] or c > got["least"]})
    # Two small searches in place of one over all ranges.
    step = isqrt(len(starts)) + 1
    groups = [starts[i: i + step] for i in range(0, len(starts), step)]
    id_ = F.col("doc_id")

    def below(values):
        held = F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<bigint>")
        return F.size(F.filter(held, lambda v: v <= id_))

    group = F.coalesce(below([g[0] for g in groups]), F.lit(0))
    part = F.lit(0)
    for g, values in reversed(list(enumerate(groups, 1))):
        part = F.when(F.col("_group") == g, (g - 1) * step + below(values)).otherwise(part)
    start = F.lit(False)
    for g, values in reversed(list(enumerate(groups, 1))):
        start = F.when(F.col("_group") == g, id_.isin(values)).otherwise(start)
    first = id_.isNull() if got["nulls"] else id_ == F.lit(got["least"])
    place = F.array_compact(F.array(
        F.struct(F.col("_part").alias("part"), F.lit(0).alias("role")),
        F.when(F.col("_start"), F.struct((F.col("_part") - 1).alias("part"), F.lit(1).alias("role"))),
        F.when(first, F.struct(F.lit(len(starts)).alias("part"), F.lit(2).alias("role"))),
    ))
    rows = documents.withColumn("_group", group).withColumn("_part", part).withColumn("_start", start)
    rows = rows.select("doc_id", "text", F.explode(place).alias("at")).select("doc_id", "text", "at.part", "at.role")
    w = Window.partitionBy("part").orderBy("role", F.col("doc_id").asc_nulls_first(), "text")
    out = rows.select(
        "doc_id", "text", "part", "role", F.row_number().over(w).alias("nr"),
        F.lead("text").over(w).alias("next_text"), F.lead("role").over(w).alias("_then"),
    ).where("role = 0")
    inside = F.col("_then") == 0
    return out.select(
        "doc_id", "text", "next_text", "part", "nr",
        F.when(inside, F.col("part")).when(F.col("_then") == 1, F.col("part") + 1).otherwise(F.lit(0)).alias("next_part"),
        F.when(inside, F.col("nr") + 1).otherwise(F.lit(1)).alias("next_nr"),
    )


def edited(text: Column, following: Column) -> Column:
    """``text`` whose last half is replaced by as many first characters of ``following``, or all."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def edited_fingerprints(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    ``near_found`` is, for ids divisible by 100, the number of rows whose
    fingerprint lies within ``radius`` (the row itself counts), else null.
    ``near_class`` is, for every row that such an id finds, the least id that
    finds it, else null.
    """
    documents = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = in_order(documents).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    facts = F.struct(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), "next_part", "next_nr",
    )
    # The facts ride on the row of the edited text.
    both = rows.select("part", "nr", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"), F.lit(None).cast(_type(rows, facts)).alias("facts")),
        F.struct(F.lit(1).alias("kind"), F.col("edit").alias("text"), facts.alias("facts")),
    )).alias("x")).select("part", "nr", "x.kind", "x.text", "x.facts")
    prints = fingerprints(both, ["part", "nr", "kind", "facts"])
    own = F.when(F.col("kind") == 0, F.struct("high", "low"))
    edit = F.when(F.col("kind") == 1, F.struct("high", "low"))
    prints = checkpointed(prints.groupBy("part", "nr").agg(
        F.max(own).alias("own"), F.max(edit).alias("edit"), F.max("facts").alias("f"),
    ).select("part", "nr", "f.*", "own.high", "own.low", F.col("edit.high").alias("e_high"), F.col("edit.low").alias("e_low")))

    following = prints.select(
        F.col("part").alias("next_part"), F.col("nr").alias("next_nr"),
        F.col("high").alias("n_high"), F.col("low").alias("n_low"),
    )
    distinct = prints.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"))
    is_asked = F.col("doc_id") % 100 == 0
    asked = prints.where(is_asked).groupBy("high", "low").agg(F.min("doc_id").alias("q_id"))
    # A pair counts for the one that asks and names it to the one that is found.
    told = F.explode(F.array(
        F.struct(F.col("q_high").alias("high"), F.col("q_low").alias("low"), F.col("n"), F.lit(None).cast("long").alias("q_id")),
        F.struct("high", "low", F.lit(None).cast("long").alias("n"), "q_id"),
    ))
    found = near(asked, distinct, radius).select(told.alias("x")).groupBy("x.high", "x.low").agg(
        F.sum("x.n").alias("near_found"), F.min("x.q_id").alias("near_class"))
    counted = prints.select("part", "nr", "doc_id", "high", "low").join(found, ["high", "low"]).select(
        "part", "nr", F.when(is_asked, F.col("near_found")).alias("near_found"), "near_class")
    own, edit, then = ((F.col(h), F.col(w)) for h, w in (("high", "low"), ("e_high", "e_low"), ("n_high", "n_low")))
    out = prints.join(following, ["next_part", "next_nr"]).join(counted, ["part", "nr"], "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(*own).alias("fingerprint"), as_text(*edit).alias("edited_fingerprint"),
        likeness(own, edit).alias("near_edited"), likeness(own, then).alias("near_next"), "near_found", "near_class",
    )


def _type(rows: DataFrame, column: Column) -> str:
    return rows.select(column.alias("c")).schema["c"].dataType.simpleString()
