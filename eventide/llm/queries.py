"""Queries over the corpus tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from eventide.llm import decontaminate, html_text, langid, line_dedup, ngram_join, packing, quality, secrets, sharding, topk
from eventide.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.line_dedup(docs, n_dropped="n_dropped").select("doc_id", "source", "text", "n_dropped")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies stay together, by bytes, on 64 shards."""
    return sharding.shard_groups(table(spark, sf_dir, "documents"), F.md5("text"), F.octet_length("text"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, against all vectors."""
    return topk.top_k_products(table(spark, sf_dir, "embeddings"), asked=F.col("id") % 50 == 0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.label_languages(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, with its class and its number of links."""
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = [
        op1_line_dedup, op2_quality_classifier, op3_secret_scan, op4_lpt_sharding, op5_html_extraction,
        op6_exact_top_k, op7_decontamination, op8_best_fit_packing, op9_language_id, op10_ngram_jaccard_join,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that it can express; the others are tested against brute force."""
    out = {
        "op1_line_dedup": line_dedup.SQL, "op4_lpt_sharding": sharding.SQL, "op6_exact_top_k": topk.SQL,
        "op7_decontamination": decontaminate.SQL, "op10_ngram_jaccard_join": ngram_join.SQL,
    }
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
