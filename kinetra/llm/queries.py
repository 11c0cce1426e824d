"""One query per operator: production parameters over whole tables, and the SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.llm import decontamination, neardup, packing, quality, sharding, suffixes, tokens, tokenstore, topk, toxicity, wrappers
from kinetra.session import shared_dir, ship, table

SQL: dict[str, str] = {}

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, by rows and by bytes, so that a worker holds few texts at once; both stay set for the session."""
    ship(spark)
    spark.conf.set(ARROW_ROWS, "1000")
    spark.conf.set(ARROW_BYTES, str(8 << 20))
    return spark


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + ", '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

SQL["op1_benchmark_decontamination"] = f"""
WITH item AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[k:k + 9], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM item WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
doc AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
place AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM doc, sizes WHERE len(ws) >= n),
found AS (
  SELECT p.doc_id, p.k, p.n, w.item_id
  FROM (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM place) p JOIN win w ON p.n = w.n AND p.win = w.win),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


def op2_best_fit_decreasing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


TOKENIZER = "word_bpe_49k.json"


def op6_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.public(TOKENIZER))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    path = f"{shared_dir(spark)}/kinetra-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex[:12]}"
    tokenstore.write(table(spark, sf_dir, "documents"), path, tokens.public(TOKENIZER))
    return tokenstore.read(spark, path)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set(ARROW_ROWS, "10000")
    return topk.top_k(table(spark, sf_dir, "embeddings"))


SQL["op8_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pair) WHERE rank <= 5
"""


def op3_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op5_weighted_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, and whether it is the one that stays."""
    tuned(spark)
    found = neardup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("keeps"))


def op4_union_free_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    out = wrappers.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
