"""Nearest neighbours by vantage-point trees, one per shard.

Rows repeated with id and vector are folded, and the rest is dealt to shards by a hash of both. A shard's equal vectors are
folded, and a tree is built: an inner node
has a vantage point and the median distance to it, a leaf has a few hundred vectors. Queries come in blocks; every block
goes to every shard, and what the shards find is merged by query.

With r the distance of a query to a vantage point, m the median and t the query's k-th best so far, the far side can hold
nothing better if |r − m| > t (triangle inequality). The test is relaxed to ``factor · |r − m| > t``: a factor above one
prunes more and may miss neighbours, factor one is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, q

SHARD = 4096        # vectors in a shard, about
BLOCK = 4096        # queries in a block, about
LEAF = 256
FACTOR = 1.5
K = 10


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of ``a`` and of ``b``; squares are added up component by component, in order."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        step = a[:, k, None] - b[None, :, k]
        step *= step
        total += step
    return np.sqrt(total)


class Tree:
    """Vantage-point tree over the distinct vectors of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.argsort(ids, kind="stable")
        self.vectors, back = np.unique(vectors[order], axis=0, return_inverse=True)
        back = back.ravel()
        by = np.argsort(back, kind="stable")
        ids, back = ids[order][by], back[by]            # of equal vectors together, ascending
        first = np.ones(len(ids), bool)
        first[1:] = (ids[1:] != ids[:-1]) | (back[1:] != back[:-1])
        self.ids, back = ids[first], back[first]        # an id once per vector
        self.start = np.searchsorted(back, np.arange(len(self.vectors) + 1))
        self.repeated = len(np.unique(self.ids)) < len(self.ids)    # ids with several vectors
        self.leaf = leaf
        self.root = self._build(np.arange(len(self.vectors)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # the row farthest from an arbitrary one sees the others well spread
        vantage = rows[int(np.argmax(distances(self.vectors[rows[:1]], self.vectors[rows])[0]))]
        rest = rows[rows != vantage]
        d = distances(self.vectors[[vantage]], self.vectors[rest])[0]
        middle = float(np.median(d))
        near = d <= middle
        if near.all():
            return rows  # all at one distance: nothing to split by
        return int(vantage), middle, self._build(rest[near]), self._build(rest[~near])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest of each query, its own id left out; missing ones are infinite."""
        best = np.full((len(queries), k), np.inf)
        who = np.full((len(queries), k), np.iinfo(np.int64).max)

        def offer(active: np.ndarray, rows: np.ndarray) -> np.ndarray:
            d = distances(queries[active], self.vectors[rows])
            counts = np.minimum(self.start[rows + 1] - self.start[rows], k + 1)   # of equal vectors the smallest ids are enough
            spots = np.repeat(self.start[rows] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            wide, ids = np.repeat(d, counts, axis=1), self.ids[spots]
            wide = np.where(ids[None, :] == own[active][:, None], np.inf, wide)
            all_d = np.hstack((best[active], wide))
            all_i = np.hstack((who[active], np.broadcast_to(ids, wide.shape)))
            all_i = np.where(np.isinf(all_d), np.iinfo(np.int64).max, all_i)
            if self.repeated:   # of an id the nearest occurrence keeps its slot
                by_id = np.lexsort((all_d, all_i))
                all_d, all_i = np.take_along_axis(all_d, by_id, 1), np.take_along_axis(all_i, by_id, 1)
                again = all_i[:, 1:] == all_i[:, :-1]
                all_d[:, 1:][again], all_i[:, 1:][again] = np.inf, np.iinfo(np.int64).max
            keep = np.lexsort((all_i, all_d))[:, :k]
            best[active], who[active] = np.take_along_axis(all_d, keep, 1), np.take_along_axis(all_i, keep, 1)
            return d

        def visit(node, active: np.ndarray) -> None:
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                if len(node):
                    offer(active, node)
                return
            vantage, middle, inside, outside = node
            r = offer(active, np.array([vantage]))[:, 0]
            gap = np.abs(r - middle) * factor * (1 - 1e-12)
            inner = r <= middle
            visit(inside, active[inner])
            visit(outside, active[~inner])
            visit(outside, active[inner][gap[inner] <= best[active[inner], k - 1]])
            visit(inside, active[~inner][gap[~inner] <= best[active[~inner], k - 1]])

        visit(self.root, np.arange(len(queries)))
        return best, who


def _search(k: int, factor: float, leaf: int):
    """One shard's vectors and one block of queries → the shard's nearest for each query."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        query, ids = rows.column("query").to_numpy(), rows.column("id").to_numpy()
        vectors = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, key[1].as_py())
        own, wanted = ids[query], vectors[query]
        d, who = Tree(ids[~query], vectors[~query], leaf).search(wanted, own, k, factor)
        found = np.isfinite(d)
        return pa.table({"query_id": pa.array(np.repeat(own, found.sum(1)), pa.int64()), "vec_id": pa.array(who[found], pa.int64()),
                         "score": pa.array(d[found], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, factor: float = FACTOR, every: int = 100, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_rows: int = SHARD, block_rows: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest vectors found for each query, nearest first, ties to the smaller id.

    ``queries`` (same columns) defaults to the vectors whose id is divisible by ``every``. A vector with a query's id is not its
    neighbour. Vectors and queries with a null id, null, zero, or with null or non-finite components take no part; vectors are compared
    with those of the same length only. Rows repeated with id and vector are one candidate each; of the same id twice, the nearer
    counts. With fewer than k candidates all are returned; an empty table gives an empty result.
    """
    def clean(df: DataFrame) -> DataFrame:
        return df.select(q(id_col).cast("long").alias("id"), q(vector_col).cast("array<double>").alias("vector")).where(
            F.col("id").isNotNull() & usable(F.col("vector"))).distinct()

    all_ = materialize(clean(vectors), "vectors")
    asked = all_.where(F.pmod("id", F.lit(every)) == 0) if queries is None else materialize(clean(queries), "queries")
    shards = max(1, math.ceil(all_.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / block_rows))
    shard = F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit("block"), "id", "vector"), F.lit(blocks)).cast("int")
    # the stated query set meets all vectors: every block meets every shard
    dealt = all_.select(shard.alias("shard"), F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                        F.lit(False).alias("query"), "id", "vector")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("vector").alias("dim"), block.alias("block"),
                        F.lit(True).alias("query"), "id", "vector")
    found = dealt.unionByName(sent).groupBy("shard", "dim", "block").applyInArrow(_search(k, factor, leaf), "query_id long, vec_id long, score double")
    found = materialize(found, "found")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
