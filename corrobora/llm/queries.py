"""The operators of this subpackage as registered queries, with their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corrobora.llm import (ctw, decontaminate, html_text, langid, mixing, near_dup, oracles, periodic, pii,
                           quality, sharding, topk, toxicity, whitening)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), near_dup.DedupSpec(words=4))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op4_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(hits)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.with_planted_runs(_table(spark, sf_dir, "documents")))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_html_extraction, op3_exact_top_k, op4_language_model_scores, op5_toxicity,
    op6_benchmark_decontamination, op7_language_id, op8_quality, op9_source_mixing, op10_sharding,
    op11_embedding_whitening, op12_periodic_runs, op13_personal_data)}
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": oracles.near_duplicates(),
    "op3_exact_top_k": oracles.top_k(),
    "op6_benchmark_decontamination": oracles.contamination(),
    "op9_source_mixing": oracles.source_mixing(),
    "op10_sharding": oracles.sharding(),
}
