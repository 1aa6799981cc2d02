"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.values import q
from ..session import materialize

# The white space of the operators' contracts, as a character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

HASH_RANGE = 1 << 62

BROADCAST_BYTES = 8 << 20

BATCH_BYTES = 4 << 20   # of texts that are given to Python at a time


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers of a session that was started without it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="veilframe-code-"), "veilframe.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What is computed inside goes to Python in batches of about ``size`` bytes, unless the session has a size of its own.

    By rows alone a batch of long texts takes tens of MB, in the executor and again in its Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(q(name).cast("string"), F.lit(""))


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(f"{WORD}+")).cast("long")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Working column names that clash with no column of ``df``."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in wanted:
        while f"__{name}".lower() in taken:
            name += "_"
        taken.add(f"__{name}".lower())
        names.append(f"__{name}")
    return names


def small_side(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit into ``BROADCAST_BYTES``, else as it is (a shuffled join).

    ``df`` is expected to be cheap to count: a table written before.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def hashed_share(parts: list[Column], share: float) -> Column:
    """True for about ``share`` of the rows, decided by a hash of ``parts``."""
    return F.pmod(F.xxhash64(F.lit(20241), *parts), F.lit(HASH_RANGE)) < F.lit(int(min(1.0, max(0.0, share)) * HASH_RANGE))


__all__ = ["SPACE", "WORD", "BROADCAST_BYTES", "fresh", "hashed_share", "materialize", "q", "ship_package", "small_batches", "small_side", "text_or_empty", "word_count"]
