"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, html, langid, packing, quality, sharding, simhash, substring, tokenstore, topk, toxicity, whitening
from ._common import table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_table(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_table(table(spark, sf_dir, "documents"))


#: Window for window, with the first document that has the same words.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1)::BIGINT)) AS s FROM d),
g AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS words FROM t),
f AS (
  SELECT words, min(doc_id) AS first_id FROM g GROUP BY words),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT g.doc_id, unnest(range(g.s, g.s + 13)) AS p FROM g JOIN f USING (words) WHERE g.doc_id > f.first_id)),
lists AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
placed AS (
  SELECT d.doc_id, d.w, unnest(range(1, len(d.w) + 1)) AS p FROM d),
kept AS (
  SELECT placed.doc_id, string_agg(placed.w[placed.p], ' ' ORDER BY placed.p) AS line
  FROM placed LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY placed.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(lists.ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.line, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


#: Every query against every other row.
OP7_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def op8_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_table(table(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_langid, op3_packing, op4_quality, op5_substring, op6_html, op7_topk, op8_tokenstore, op9_bpe, op10_simhash, op11_audit, op12_sharding, op13_whitening)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": quality.sql(), "op5_substring": OP5_SQL, "op7_topk": OP7_SQL, "op11_audit": audit.SQL}
