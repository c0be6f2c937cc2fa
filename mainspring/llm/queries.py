"""The corpus operators as queries over whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontam, language, mixing, pii, quality, secrets, simhash, topk, toxicity
from ._common import table


def op1_language(spark, sf_dir):
    return language.identify_language(table(spark, sf_dir, "documents"))


def op2_secrets(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op5_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_preferences(spark, sf_dir):
    return chat.format_preferences(chat.revisit_pairs(table(spark, sf_dir, "conversations")))


def op9_personal_data(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    own = (op1_language, op2_secrets, op3_decontamination, op4_topk, op5_toxicity, op6_mixing, op7_simhash, op8_preferences, op9_personal_data, op10_quality)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": TOPK, "op8_preferences": PREFERENCES}


TOPK = """
WITH own AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM own q JOIN own c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

PREFERENCES = """
WITH own AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations
), ends AS (
  SELECT conv_id, min(k) AS a, max(k) AS z FROM own WHERE role = 'assistant' GROUP BY conv_id
), two AS (
  SELECT o.conv_id, o.k, z, role, text, CASE WHEN k = z THEN (SELECT f.text FROM own f WHERE f.conv_id = o.conv_id AND f.k = a) ELSE text END AS other
  FROM own o JOIN ends e ON o.conv_id = e.conv_id AND k <= z
), common AS (
  SELECT conv_id, CASE WHEN bool_or(k = z AND text IS DISTINCT FROM other) THEN max(z) - 1 ELSE max(z) END AS n FROM two GROUP BY conv_id
), parts AS (
  SELECT t.conv_id, k, n, role, '<|' || role || '|>' || chr(10) AS head,
    text || '<|end|>' || chr(10) AS body, other || '<|end|>' || chr(10) AS other_body FROM two t JOIN common c ON t.conv_id = c.conv_id
)
SELECT conv_id AS pair_id, max(n)::BIGINT AS common,
  coalesce(string_agg(head || body, '' ORDER BY k) FILTER (k <= n), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY k) FILTER (k > n), '') AS chosen,
  coalesce(string_agg(head || other_body, '' ORDER BY k) FILTER (k > n), '') AS rejected,
  coalesce(string_agg(length(head) || ':' || length(head || body), ',' ORDER BY k) FILTER (k > n), '') AS chosen_mask,
  coalesce(string_agg(length(head) || ':' || length(head || other_body), ',' ORDER BY k) FILTER (k > n), '') AS rejected_mask
FROM parts GROUP BY conv_id
"""
