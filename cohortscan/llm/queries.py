"""Queries over the given tables, one for each operator of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortscan.llm.common import table
from cohortscan.llm.jaccard import jaccard_join
from cohortscan.llm.language import language
from cohortscan.llm.mixing import mixed_sources
from cohortscan.llm.nearest import search
from cohortscan.llm.pieces import round_trip
from cohortscan.llm.pii import personal_data
from cohortscan.llm.prefixes import prefix_trie
from cohortscan.llm.quality import quality
from cohortscan.llm.rules import quality_rules
from cohortscan.llm.simhash import edited_fingerprints
from cohortscan.llm.toxicity import toxicity
from cohortscan.llm.urls import LISTED, RULES, judge
from cohortscan.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql is not None:
        ORACLES[fn.__name__] = sql
    return fn


@query
def op10_toxicity(spark: SparkSession, path: str) -> DataFrame:
    return toxicity(table(spark, path, "documents"), table(spark, path, "labels"))


@query
def op6_quality_classifier(spark: SparkSession, path: str) -> DataFrame:
    return quality(table(spark, path, "documents"), table(spark, path, "labels"))


@query
def op2_language_id(spark: SparkSession, path: str) -> DataFrame:
    return language(table(spark, path, "documents"))


@query
def op5_sentencepiece(spark: SparkSession, path: str) -> DataFrame:
    return round_trip(table(spark, path, "documents"), piece_model())


def op1_url_filter(spark: SparkSession, path: str) -> DataFrame:
    return judge(table(spark, path, "pages"), RULES + LISTED)


def _url_sql() -> str:
    rows = ", ".join(f"('{e.pattern}', '{e.verdict}', '{e.kind}')" for e in RULES + LISTED)
    return f"""
WITH entries(pattern, verdict, kind) AS (VALUES {rows}),
parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    row_number() OVER () AS nr
  FROM pages),
hits AS (
  SELECT nr, pattern, entries.verdict, kind FROM parts JOIN entries
  ON concat('.', host, path) LIKE concat('%.', pattern, '%')
   AND (host = split_part(pattern, '/', 1) OR ends_with(host, concat('.', split_part(pattern, '/', 1))))
   AND starts_with(path, substr(pattern, strpos(pattern, '/')))),
best AS (
  SELECT *, row_number() OVER (PARTITION BY nr ORDER BY kind = 'rule' DESC, length(pattern) DESC) AS rank FROM hits)
SELECT page_id, host, path, CASE WHEN kind = 'rule' THEN pattern END AS rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM best WHERE rank = 1) b USING (nr)"""


query(op1_url_filter, _url_sql())


@query
def op4_source_mix(spark: SparkSession, path: str) -> DataFrame:
    return mixed_sources(table(spark, path, "documents"))


@query
def op9_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return edited_fingerprints(table(spark, path, "documents"))


@query
def op3_personal_data(spark: SparkSession, path: str) -> DataFrame:
    return personal_data(table(spark, path, "documents"))


def op8_jaccard_join(spark: SparkSession, path: str) -> DataFrame:
    return jaccard_join(table(spark, path, "documents"))


query(op8_jaccard_join, r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM words),
sets AS (SELECT list_sort(g) AS g, min(doc_id) AS node, count(*) AS m FROM grams WHERE len(g) > 0 GROUP BY 1),
flat AS (SELECT node, len(g) AS n, unnest(g) AS x FROM sets),
hits AS (
  SELECT a.node AS a, b.node AS b FROM flat a JOIN flat b USING (x) WHERE a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING count(*) * 9 >= 4 * (a.n + b.n)),
reach(a, b) AS (SELECT node, node FROM sets UNION SELECT reach.a, hits.b FROM reach JOIN hits ON reach.b = hits.a),
labels AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY 1),
counted AS (SELECT a AS node, sum(m) AS links FROM hits JOIN sets ON hits.b = sets.node GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id,
  CAST(coalesce(m - 1 + coalesce(links, 0), 0) AS BIGINT) AS n_links
FROM grams LEFT JOIN sets ON list_sort(grams.g) = sets.g
LEFT JOIN labels USING (node) LEFT JOIN counted USING (node)""")


@query
def op7_nearest(spark: SparkSession, path: str) -> DataFrame:
    return search(table(spark, path, "embeddings"))


@query
def op11_whitening(spark: SparkSession, path: str) -> DataFrame:
    return whiten(table(spark, path, "embeddings"))


@query
def op12_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    return quality_rules(table(spark, path, "documents"), table(spark, path, "labels"))


def op13_prefix_trie(spark: SparkSession, path: str) -> DataFrame:
    return prefix_trie(table(spark, path, "conversations"))


# Ids are few beside turns, so their crc32 is worked out bit by bit.
query(op13_prefix_trie, r"""
WITH RECURSIVE own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS nr,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
      lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT h.conv_id, nr, x FROM heads h JOIN own ON own.conv_id = h.base AND nr <= h.h
  UNION ALL SELECT h.conv_id, nr, x FROM heads h JOIN own ON own.conv_id = h.conv_id AND nr > h.h),
built AS (
  SELECT conv_id, coalesce(list(x ORDER BY nr) FILTER (WHERE nr IS NOT NULL), []) AS s
  FROM heads LEFT JOIN turns USING (conv_id) GROUP BY 1),
prefixes AS (SELECT conv_id, d, s[1:d] AS p, len(s) AS n FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built)),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2),
named AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[-1].t, '[^ 	-]+')) END AS own FROM nodes),
links AS (SELECT c.d, c.conv_id, p.conv_id AS parent FROM named c JOIN named p ON p.d = c.d - 1 AND p.p = c.p[1:c.d - 1]),
kids AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n_children FROM links GROUP BY 1, 2),
flat AS (SELECT n.*, l.parent, coalesce(n_children, 0) AS n_children FROM named n LEFT JOIN links l USING (d, conv_id) LEFT JOIN kids USING (d, conv_id)),
up AS (
  SELECT d, conv_id, parent, own, CAST(n_children = 0 AS BIGINT) AS leaf FROM flat
  UNION ALL SELECT f.d, f.conv_id, f.parent, up.own, up.leaf FROM up JOIN flat f ON f.d = up.d - 1 AND f.conv_id = up.parent),
sums AS (SELECT d, conv_id, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM up GROUP BY 1, 2)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM flat JOIN sums USING (d, conv_id)""")
