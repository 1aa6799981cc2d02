"""The queries of this subpackage: name → (spark, data folder) → DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import sql
from .alignment import alignments
from .common import ship_package
from .exact_dedup import exact_duplicates
from .minhash import near_duplicates
from .mixing import mixed_words
from .packing import packed_documents
from .prefix_trie import prefix_trie
from .quality import quality_scores
from .token_counts import token_counts
from .token_output import round_trip
from .toxicity import toxicity_scores
from .url_filter import judge_urls
from .vptree import nearest
from .weak_rules import weak_quality


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(_table(spark, folder, "documents"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(_table(spark, folder, "pages"))


def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_words(_table(spark, folder, "documents"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(_table(spark, folder, "embeddings"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"), link=(85, 100)).select("doc_id", "n_shingles", "component_id", "kept")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignments(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_weak_rules(spark: SparkSession, folder: str) -> DataFrame:
    return weak_quality(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(_table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_source_mix": op3_source_mix,
    "op4_token_counts": op4_token_counts,
    "op5_nearest": op5_nearest,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_token_output": op8_token_output,
    "op9_near_dedup": op9_near_dedup,
    "op10_packing": op10_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_weak_rules": op12_weak_rules,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL: dict[str, str] = {
    "op1_exact_dedup": sql.OP1,
    "op5_nearest": sql.OP5,
    "op9_near_dedup": sql.OP9,
    "op12_weak_rules": sql.OP12,
    "op13_prefix_trie": sql.OP13,
}
