"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlake.llm import bpe, dedup, html, langid, lm, merkle, mixing, quality, sharding, topk, urls, variants, warc
from loomlake.llm.common import table
from loomlake.llm.sql import ORACLE_SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": lambda spark, d: dedup.near_duplicates(table(spark, d, "documents")),
    "op2_html_main_text": lambda spark, d: html.extract(table(spark, d, "pages")),
    "op3_warc_index": lambda spark, d: warc.archive(table(spark, d, "pages")).drop("archive", "offset"),
    "op4_exact_top_k": lambda spark, d: topk.top_k(table(spark, d, "embeddings")),
    "op5_quality_rules": lambda spark, d: quality.score(table(spark, d, "documents")),
    "op6_mix_sources": lambda spark, d: mixing.mix(table(spark, d, "documents")),
    "op7_url_filter": lambda spark, d: urls.judge(table(spark, d, "pages")),
    "op8_shard_shuffle": lambda spark, d: sharding.assign(table(spark, d, "documents")),
    "op9_bpe_round_trip": lambda spark, d: bpe.digests(table(spark, d, "documents")),
    "op10_language_id": lambda spark, d: langid.predict(table(spark, d, "documents")),
    "op11_lm_score": lambda spark, d: lm.score(table(spark, d, "documents")),
    "op12_merkle_manifest": lambda spark, d: merkle.manifest(table(spark, d, "documents")),
    "op13_spelling_variants": lambda spark, d: variants.group(table(spark, d, "documents")),
}

