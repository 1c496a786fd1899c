"""Registered queries of the training-data operators and, where SQL can express one, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sinkweave.llm import bpe, decontaminate, divergence, licenses, pages, pii, quality, sharding, simhash, topk, toxicity, trie, urls
from sinkweave.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace(table(spark, sf_dir, "documents"), pii.key_of(spark))
    return out.select("doc_id", "text", F.col("pii_entities").alias("n_entities"), F.col("pii_kinds").alias("kinds"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.rebuild(table(spark, sf_dir, "conversations")))


OP2_SQL = r"""
WITH iw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
ig AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, w[i + 1 : i + least(len(w), 13)] AS g
  FROM (SELECT item, w, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
dg AS (
  SELECT doc_id, n, i, w[i + 1 : i + n] AS g
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i
        FROM dw, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n)),
hit AS (SELECT dg.doc_id, dg.i, dg.n, ig.item FROM dg JOIN ig ON dg.g = ig.g AND dg.n = ig.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


OP11_SQL = r"""
WITH tok AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
occ AS (SELECT d, lang, source, unnest(w) AS term FROM tok),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
grp AS (SELECT DISTINCT lang, source FROM tok),
here AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN here h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
gp AS (SELECT d.lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY d.lang, source) + 2 * v.v) AS p FROM dense d JOIN v ON v.lang = d.lang),
lp AS (SELECT s.lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY s.lang) + 2 * v.v) AS q FROM (SELECT lang, term, sum(n) AS n FROM here GROUP BY lang, term) s JOIN v ON v.lang = s.lang),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(pr.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
terms AS (SELECT gp.lang, gp.source, gp.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM gp JOIN lp ON lp.lang = gp.lang AND lp.term = gp.term WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP12_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c AS (SELECT r, vec_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM e),
met AS (SELECT q.r AS qr, c.r AS cr, sum(q.w * c.w) AS score FROM c q JOIN c ON q.i = c.i AND q.r <> c.r WHERE q.vec_id % 100 = 0 GROUP BY q.r, c.r),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(met.score, 0) AS score,
         row_number() OVER (PARTITION BY q.r ORDER BY coalesce(met.score, 0) DESC, c.vec_id NULLS LAST) AS rank
  FROM e q JOIN e c ON q.r <> c.r LEFT JOIN met ON met.qr = q.r AND met.cr = c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
"""


OP13_SQL = """
WITH RECURSIVE crc AS (
  SELECT conv_id, CAST(4294967295 AS BIGINT) AS r, CAST(conv_id AS VARCHAR) AS rest FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT conv_id, list_reduce([xor(r, CAST(unicode(rest) AS BIGINT))] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: xor(a // 2, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END)), rest[2:]
  FROM crc WHERE rest <> ''),
convs AS (SELECT conv_id AS c, xor(r, 4294967295) % 9 AS h, conv_id - conv_id % 5 AS kin FROM crc WHERE rest = ''),
said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS t
  FROM said GROUP BY conv_id),
rebuilt AS (SELECT c, coalesce(k.t, [])[1 : h] || o.t[h + 1 :] AS t FROM convs JOIN own o ON o.conv_id = c LEFT JOIN own k ON k.conv_id = kin),
member AS (SELECT c, len(t) AS n, d, t[1 : d] AS path FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256,
         CASE WHEN d > 0 THEN (count(*) - 1) * strlen(path[d].text) ELSE 0 END AS own
  FROM member GROUP BY d, path),
kids AS (SELECT path[1 : d - 1] AS path, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
under AS (
  SELECT a.d, a.path, CAST(sum(x.own) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves
  FROM (SELECT path[1 : j] AS path, j AS d, x.path AS full_path, x.d AS full_d, x.own FROM (SELECT path, d, own, unnest(range(0, d + 1)) AS j FROM node) x) x
  JOIN node a ON a.d = x.d AND a.path = x.path LEFT JOIN kids k ON k.d = x.full_d AND k.path = x.full_path GROUP BY a.d, a.path)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, u.n_leaves, u.saved_tokens, n.ends_sha256
FROM node n JOIN under u ON u.d = n.d AND u.path = n.path LEFT JOIN kids k ON k.d = n.d AND k.path = n.path
LEFT JOIN node p ON p.d = n.d - 1 AND p.path = n.path[1 : n.d - 1]
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_sharding, op2_decontamination, op3_simhash, op4_toxicity, op5_html,
        op6_licenses, op7_quality, op8_bpe, op9_pii, op10_urls, op11_divergence, op12_topk, op13_prefix_trie,
    )
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op11_divergence": OP11_SQL, "op12_topk": OP12_SQL, "op13_prefix_trie": OP13_SQL}
