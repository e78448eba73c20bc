"""The corpus operators' registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, line_dedup, media, near_dedup, packing, secrets, sharding, token_counts, toxicity
from .base import documents


def op1_media(spark, sf_dir):
    return media.digests(documents(spark, sf_dir))


def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir))


def op3_secrets(spark, sf_dir):
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(secrets.listed(F.filter("spans", lambda s: s["order"] < len(base))), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op4_packing(spark, sf_dir):
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(documents(spark, sf_dir))


def op6_sharding(spark, sf_dir):
    return sharding.assign_shards(documents(spark, sf_dir))


def op7_line_dedup(spark, sf_dir):
    kept = line_dedup.drop_shared_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op9_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_media, op2_token_counts, op3_secrets, op4_packing, op5_byte_bpe, op6_sharding, op7_line_dedup, op8_near_dedup, op9_toxicity, op10_exact_dedup)}

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLE_SQL = {
    "op7_line_dedup": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs
),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT keyed.doc_id, pos, line, keeper IS NOT NULL AND keeper <> keyed.doc_id AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
}
