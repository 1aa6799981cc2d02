"""Token counts with the whole-token shortcut.

Offline, once for a process, the vocabulary is studied (``tokenizers_fast.plan``): which of its strings are one
pre-token and are merged into exactly one token. Tasks split texts into pre-tokens, count those strings at once and
merge only the rest.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import q, text_or_empty
from .tokenizers_fast import Counter, plan, shared_encoder

OVER = 512


def token_counter(path: str):
    """Column function: text → number of tokens, as the library for the vocabulary file counts them."""
    settled = plan(path)

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        count = shared_encoder(Counter, settled).of_text
        return pa.array([count(text) if text else 0 for text in texts.to_pylist()], pa.int64())

    return n_tokens


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", over: int = OVER) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``over`` tokens).

    Counts are of the whole text, without added tokens, truncation or padding; the string of a special token inside a
    text is that token, as by the library's default. A null text is an empty one and has none. Each row is counted by
    itself: repeated rows and null ids stay as they are, an empty table gives an empty result.
    """
    text: Column = text_or_empty(text_col)
    return (docs.select(q(id_col).alias("doc_id"), text.alias("text"))
            .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), token_counter(path)("text").alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit")))
