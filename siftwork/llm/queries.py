"""The registered queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, html_extract, language, mixing, neardup, packing, secret_scan, sharding, substring, topk
from .common import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, sf_dir))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_docs(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return language.identify_documents(docs, language.fit_text_model(docs))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(table(spark, sf_dir, "pages"), language.fit_text_model(_docs(spark, sf_dir)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_docs(spark, sf_dir))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 asks; all vectors are searched."""
    return topk.top_neighbours(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_docs(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return secret_scan.find_secrets(docs, secret_scan.fit_secret_model(docs))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_html_extract, op3_best_fit_packing, op4_fingerprints, op5_language_id, op6_substring_dedup, op7_exact_topk, op8_sharding, op9_secret_scan, op10_simhash_near_dedup, pages_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.SQL, "op4_fingerprints": fingerprint.SQL, "op6_substring_dedup": substring.SQL, "op7_exact_topk": topk.SQL}
