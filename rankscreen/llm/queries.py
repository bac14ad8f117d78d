"""One query per operator, over whole tables with production parameters, and the SQL that checks those that SQL can state."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_cnn, flat_graph, hard_negatives, main_text, minhash, mixing, onebit_ann, packing, pitman_yor, quality_rules, secret_scan, spelling, suffix_dedup
from .common import documents

VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return os.fspath(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(documents(spark, sf_dir))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(documents(spark, sf_dir)))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(documents(spark, sf_dir))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_onebit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit_ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "epochs")


def op11_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("audited_recall")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.candidates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label)
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules, "op2_minhash": op2_minhash, "op3_secret_scan": op3_secret_scan, "op4_suffix_dedup": op4_suffix_dedup, "op5_pitman_yor": op5_pitman_yor, "op6_byte_cnn": op6_byte_cnn, "op7_onebit_ann": op7_onebit_ann, "op8_main_text": op8_main_text,
    "op9_packing": op9_packing, "op10_mixing": op10_mixing, "op11_flat_graph": op11_flat_graph,
    "op12_hard_negatives": op12_hard_negatives, "op13_spelling": op13_spelling,
}

SQL: dict[str, str] = {
    "op10_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         greatest(0.05::DOUBLE, CASE WHEN length(text) > 0
           THEN length(translate(text, '0123456789#*$%&|<>!{}[]~^_=+\', ''))::DOUBLE / length(text) ELSE 1.0::DOUBLE END) AS weight
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
            / weight AS key FROM sizes),
per AS (SELECT skey, source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY skey, source),
shared AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS share, 3 * source_size AS cap FROM per),
levels AS (
  SELECT *, cap::DOUBLE / share AS ratio,
         (sum(source_size) OVER () - (sum(cap) OVER w - cap))::DOUBLE / (sum(share) OVER () - (sum(share) OVER w - share))::DOUBLE AS level
  FROM shared WINDOW w AS (ORDER BY cap::DOUBLE / share, skey ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT skey, source_size,
         least(cap::DOUBLE, coalesce((SELECT arg_min(level, (ratio, skey)) FROM levels WHERE level <= ratio) * share, 0.0)) AS target
  FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
runs AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.skey ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size / 2.0::DOUBLE AS reach
  FROM keyed k JOIN parts p USING (skey))
SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN rest > 0 AND reach <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken, epochs
FROM runs""",
    "op11_flat_graph": """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT x, x AS y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON least.x = vec_id LEFT JOIN counts ON counts.x = vec_id""",
    "op12_hard_negatives": """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
}
