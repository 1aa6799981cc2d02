"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; what it returns is written as Parquet and read
again as the next one's documents. Removing the subpackage ``veilframe.llm`` removes this module's purpose with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilframe.llm.common import materialize, ship_package
from veilframe.llm.exact_dedup import drop_exact_duplicates
from veilframe.llm.minhash import drop_near_duplicates
from veilframe.llm.mixing import mix
from veilframe.llm.packing import packed_documents
from veilframe.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship_package(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    ship_package(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one stays (five words, similarity 0.8 or more)."""
    ship_package(spark)
    return drop_near_duplicates(docs, link=(80, 100))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or stay out, so that sources come near their targets."""
    ship_package(spark)
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences; a repeated document is packed as often as it was taken."""
    ship_package(spark)
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("source mix", source_mix),
          ("packing", packing)]

# The classifier's scores and the tokenizer can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
