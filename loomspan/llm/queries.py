"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, cover_tree, divergence, jaccard, lang_id, line_dedup, nn_descent, oracles, packing, quality, resampling, secret_scan, suffix_dedup, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_components(spark, table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "votes", "posterior", "quality_score", "keep")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify_languages(spark, table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(spark, table(spark, sf_dir, "documents"), keep_text=False)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.search(spark, table(spark, sf_dir, "embeddings"), lambda vec_id: F.pmod(vec_id, F.lit(50)) == 0)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(spark, table(spark, sf_dir, "documents"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(spark, table(spark, sf_dir, "documents"))
    counts = [secret_scan.counted("base", name).alias(f"n_{name}") for name in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed("base"), 256).alias("base_sha256"), secret_scan.listed("spans").alias("spans"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_language_id": op6_language_id,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_warc_derivatives": op10_warc_derivatives,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_secret_scan": op12_secret_scan,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE: dict[str, str] = {"op3_embedding_near_dedup": oracles.OP3, "op7_suffix_array_dedup": oracles.OP7, "op9_ngram_jaccard_join": oracles.OP9, "op11_importance_resampling": oracles.OP11, "op13_source_divergence": oracles.OP13}
