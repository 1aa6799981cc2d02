"""Fitting without a privacy guarantee: independent columns, Gaussian copula, dependency tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.values import nan_to_null, q
from ..operators.association import PRODUCT_SUMS, correlations, pair_counts, pair_information, product_sums
from ..operators.profile import value_counts
from ..operators.roles import ColumnRoles, detect_column_roles
from ..session import materialize
from .model import NO_PARENT, Model, intervals, slot_counts
from .packed import PACKED_CELLS
from .tokens import BINS, ColumnSpec, column_specs, tokenize


def prepare_tokens(df: DataFrame, roles: ColumnRoles | None, bins: int, edges=None) -> tuple[list[ColumnSpec], DataFrame, int]:
    """Specs, the token table (written out: it is read several times) and its row count."""
    clean = nan_to_null(df)
    roles = roles or detect_column_roles(clean)
    specs = column_specs(clean, roles, bins, edges)
    if not specs:
        raise ValueError("no categorical or continuous column to learn from")
    tokens = materialize(tokenize(clean, specs), "tokens")
    rows = tokens.count()
    if rows == 0:
        raise ValueError("cannot learn from an empty table")
    return specs, tokens, rows


def token_counts(tokens: DataFrame, columns: Sequence[str]) -> DataFrame:
    return value_counts(tokens, list(columns)).select(
        F.col("column").alias("target"), F.lit(NO_PARENT).alias("parent_token"), F.col("value").alias("token"), F.col("count").alias("n"))


def fit_marginal(df: DataFrame, roles: ColumnRoles | None = None, bins: int = BINS, seed: int = 42) -> Model:
    """Every column on its own."""
    specs, tokens, rows = prepare_tokens(df, roles, bins)
    names = [s.name for s in specs]
    cells = materialize(intervals(token_counts(tokens, names)), "model")
    return Model("marginal", specs, [(c, None) for c in names], cells, slot_counts(cells), rows, seed)


@F.pandas_udf(T.DoubleType())
def normal_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Quantile of the standard normal at the middle of an interval; one value per distinct token."""
    normal = NormalDist()
    return ((a + b) / 2).clip(1e-9, 1 - 1e-9).map(normal.inv_cdf)


def score_correlations(tokens: DataFrame, names: Sequence[str], scores: DataFrame, slots: dict[str, int]) -> DataFrame:
    """``(a, b, r)`` of the columns' scores in one pass over the rows.

    ``slots`` bounds the tokens of each column. Columns with together at most ``PACKED_CELLS`` tokens are looked up
    in arrays while the products are summed; the scores of others are joined before.
    """
    small, room = [], PACKED_CELLS
    for c in names:
        if slots[c] <= room:
            small.append(c)
            room -= slots[c]
    if len(small) < len(names):
        scores = materialize(scores, "scores")
    rows = tokens
    for i, c in enumerate(names):
        if c not in small:
            part = scores.where(F.col("target") == c).select(F.col("token").alias(f"__k{i}"), F.col("score").alias(f"__z{i}"))
            rows = rows.join(part, q(c) == F.col(f"__k{i}")).drop(f"__k{i}")
    table = scores.where(F.col("target").isin(small)).toArrow()     # at most PACKED_CELLS rows
    known = {}
    for c in small:
        mine = table.filter(pc.equal(table["target"], c))
        known[c] = mine["token"].combine_chunks(), mine["score"].to_numpy()
    looked_up = [known.get(c) for c in names]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(batch: pa.RecordBatch) -> np.ndarray:
            return np.column_stack([
                column.to_numpy(zero_copy_only=False) if look is None else look[1][pc.index_in(column, value_set=look[0]).to_numpy(zero_copy_only=False)]
                for column, look in zip(batch.columns, looked_up)])
        yield product_sums((block(b) for b in batches if b.num_rows), len(looked_up))

    chosen = rows.select(*[q(c).alias(f"c{i}") if c in small else F.col(f"__z{i}").alias(f"c{i}") for i, c in enumerate(names)])
    return correlations(chosen.mapInArrow(products, PRODUCT_SUMS), names)


def fit_copula(df: DataFrame, roles: ColumnRoles | None = None, bins: int = BINS, seed: int = 42) -> Model:
    """Gaussian copula: tokens in order → normal scores → correlation of the scores."""
    specs, tokens, rows = prepare_tokens(df, roles, bins)
    names = [s.name for s in specs]
    counts = materialize(token_counts(tokens, names), "counts")
    cells = materialize(intervals(counts, ordered=True), "model")
    slots = slot_counts(cells)
    found = score_correlations(tokens, names, cells.select("target", "token", normal_score(F.col("a"), F.col("b")).alias("score")), slots)
    matrix = np.eye(len(names))
    at = {c: i for i, c in enumerate(names)}
    for r in found.collect():  # one row per pair of columns
        i, j = at[r["a"]], at[r["b"]]
        matrix[i, j] = matrix[j, i] = r["r"] or 0.0
    return Model("copula", specs, [(c, None) for c in names], cells, slots, rows, seed, factor=_factor(matrix).tolist())


def _factor(matrix: np.ndarray) -> np.ndarray:
    """Lower triangle of the nearest usable correlation matrix."""
    values, vectors = np.linalg.eigh(matrix)
    repaired = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
    scale = np.sqrt(np.diag(repaired))
    return np.linalg.cholesky(repaired / np.outer(scale, scale))


def spanning_tree(columns: Sequence[str], weights: dict[tuple[str, str], float]) -> list[tuple[str, str | None]]:
    """Maximum spanning tree over column pairs as (column, parent), parents first."""
    done, order = {columns[0]}, [(columns[0], None)]
    while len(done) < len(columns):
        best = max(((weights.get((a, b), weights.get((b, a), 0.0)), a, b) for a in columns if a in done for b in columns if b not in done),
                   key=lambda x: (x[0], x[1], x[2]))
        done.add(best[2])
        order.append((best[2], best[1]))
    return order


def fit_tree(df: DataFrame, roles: ColumnRoles | None = None, bins: int = BINS, seed: int = 42) -> Model:
    """Dependency tree (Chow & Liu): columns linked by the strongest mutual information, each
    drawn given its parent. All pair tables come from one shuffle."""
    specs, tokens, rows = prepare_tokens(df, roles, bins)
    names = [s.name for s in specs]
    pairs = list(combinations(names, 2))
    root = token_counts(tokens, names[:1])
    if not pairs:
        cells = materialize(intervals(root), "model")
        return Model("tree", specs, [(names[0], None)], cells, slot_counts(cells), rows, seed)
    table = materialize(pair_counts(tokens, pairs), "pairs")
    mi = {pairs[r["pair"]]: r["mi"] for r in pair_information(table).collect()}  # one row per pair of columns
    order = spanning_tree(names, mi)
    cells = materialize(intervals(root.unionByName(edge_counts(table, pairs, order))), "model")
    return Model("tree", specs, order, cells, slot_counts(cells), rows, seed)


def edge_counts(table: DataFrame, pairs: Sequence[tuple[str, str]], order: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Counts of each linked column given its parent, picked out of the pair tables."""
    index = {p: i for i, p in enumerate(pairs)}
    picks = []
    for child, parent in order:
        if parent is not None:
            forward = (parent, child) in index
            picks.append((index[(parent, child)] if forward else index[(child, parent)], child, forward))
    edges = F.broadcast(table.sparkSession.createDataFrame(picks, "pair int, target string, forward boolean"))  # one row per column
    return table.join(edges, "pair").select(
        "target", F.when(F.col("forward"), F.col("a")).otherwise(F.col("b")).alias("parent_token"),
        F.when(F.col("forward"), F.col("b")).otherwise(F.col("a")).alias("token"), "n")


# Further synthesizers are added by putting their fit function here.
SYNTHESIZERS = {"marginal": fit_marginal, "copula": fit_copula, "tree": fit_tree}
