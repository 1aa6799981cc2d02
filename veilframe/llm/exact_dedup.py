"""Exact duplicates with a heavy-hitter split.

1. Every task runs Misra-Gries over the digests it reads; the summaries are added up per digest. The counters bound
   the table of candidates, whatever the data.
2. The candidates are verified: their true counts and winners come from one aggregate with map-side combining. The
   verified ones are broadcast, and rows with a heavy digest are decided where they are read.
3. All other digests are shuffled as usual. None of them can be frequent, so no task gets a hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, fresh, materialize, q, text_or_empty

COUNTERS = 1024         # digests kept by a summary
HEAVY_SHARE = 1 / 1024  # a digest with a larger share of all rows counts as heavy


def normalised(name: str = "text") -> Column:
    """Text with each stretch of white space made one space; null is empty."""
    return F.regexp_replace(text_or_empty(name), f"{SPACE}+", " ")


def text_digest(name: str = "text") -> Column:
    """SHA-256 of the normalised text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(normalised(name).cast("binary"), 256))


def _misra_gries(counters: int):
    """Summary of a stream of digests: adding batch counts, then taking the next-largest count off all when too many are held."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for found in batch.column(0).value_counts().to_pylist():
                held[found["values"]] = held.get(found["values"], 0) + found["counts"]
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {digest: n - cut for digest, n in held.items() if n > cut}
        if held:
            yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})

    return summarise


def heavy_groups(keys: DataFrame, digest: str, order: Column, rows: int, counters: int = COUNTERS,
                 share: float = HEAVY_SHARE) -> DataFrame:
    """Verified frequent digests of ``keys``: ``(digest, __first, __size)``, at most ``counters`` rows.

    A digest with more than ``rows * share`` rows is found if ``share >= 1 / counters``: a summary of m rows loses at
    most m / (counters + 1) of a count. What is not found is still decided rightly, by the shuffle.
    """
    found = (keys.select(q(digest).alias("digest")).mapInArrow(_misra_gries(counters), "digest binary, n long")
             .groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters))
    candidates = F.broadcast(found.select(F.col("digest").alias(digest)))  # at most `counters` rows of 32 bytes
    return (keys.join(candidates, digest, "left_semi").groupBy(digest)
            .agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__size"))
            .where(F.col("__size") > max(1, int(rows * share))))


def mark_groups(keys: DataFrame, digest: str, order: Column, counters: int = COUNTERS, share: float = HEAVY_SHARE) -> DataFrame:
    """``keys`` with ``__first`` (the smallest ``order`` of the rows that share the digest) and ``__size``.

    ``keys`` should be a written table: it is read by each step.
    """
    heavy = materialize(heavy_groups(keys, digest, order, keys.count(), counters, share), "heavy")
    heavy = F.broadcast(heavy)  # at most `counters` rows
    group = Window.partitionBy(digest)
    rest = keys.join(heavy.select(digest), digest, "left_anti").select(
        "*", F.min(order).over(group).alias("__first"), F.count(F.lit(1)).over(group).alias("__size"))
    return keys.join(heavy, digest).select(rest.columns).unionByName(rest)


def _id_order(id_col: str, row: str) -> Column:
    return F.struct(q(id_col).isNull().alias("no_id"), q(id_col).alias("id"), q(row).alias("row"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS,
                     share: float = HEAVY_SHARE) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised forms are. The row with the smallest id stays; null ids come last. A null
    text is an empty one, and empty texts are equal. Of rows that share id and text exactly one stays. An empty table
    gives an empty result; other columns, whatever their names, are not read.
    """
    keys = materialize(docs.select(q(id_col).alias("doc_id"), text_digest(text_col).alias("digest"))
                       .withColumn("row", F.monotonically_increasing_id()), "digests")
    marked = mark_groups(keys, "digest", _id_order("doc_id", "row"), counters, share)
    return marked.select("doc_id", F.col("__first.id").alias("keep_id"), F.col("__size").alias("group_size"),
                         (F.col("row") == F.col("__first.row")).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS,
                          share: float = HEAVY_SHARE) -> DataFrame:
    """The documents that stay, with all their columns. Rules as in ``exact_duplicates``.

    Copies of heavy digests leave before the shuffle; only the rows with the winner's id go on. The others are shuffled
    once with their columns.
    """
    digest, row, winner, first, heavy_flag = fresh(docs, "digest", "row", "winner", "first", "heavy")
    keys = materialize(docs.select(q(id_col).alias("doc_id"), text_digest(text_col).alias("digest"))
                       .withColumn("row", F.monotonically_increasing_id()), "digests")
    heavy = heavy_groups(keys, "digest", F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")),
                         keys.count(), counters, share)
    heavy = F.broadcast(materialize(heavy, "heavy").select(F.col("digest").alias(digest), F.col("__first.id").alias(winner),
                                                           F.lit(True).alias(heavy_flag)))
    spread = docs.withColumns({digest: text_digest(text_col), row: F.monotonically_increasing_id()})
    # a row that cannot be the winner of a heavy digest ends here
    light = spread.join(heavy, digest, "left").where(q(heavy_flag).isNull() | q(winner).eqNullSafe(q(id_col)))
    smallest = F.min(_id_order(id_col, row)).over(Window.partitionBy(digest))
    return light.withColumn(first, smallest).where(F.col(f"{first}.row") == q(row)).select(*[q(c) for c in docs.columns])
