"""Dependence between columns: Pearson, Cramér's V, mutual information.

All pairs of label columns are counted in one shuffle: a task counts each pair over
blocks of rows, as numbers of values, so what is shuffled are cells and not rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.values import as_number, nan_to_null, q
from ..session import materialize
from .marginals import shared_columns

BLOCK_ROWS = 1 << 16        # counted at once
BLOCK_BYTES = 32 << 20
NULL_VALUE = "\u0000null"
_PAIRS_PER_AGGREGATE = 10  # wider aggregates are slower than one pass of matrix products


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, r)`` for every pair, over the rows where both are present; NULL if a
    column is constant there.

    A few pairs are one aggregate. Many pairs come from matrix products over Arrow
    batches: a task returns one row of sums per pair, whatever its number of rows.
    """
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    value = {c: as_number(c, df.schema[c].dataType) for c in columns}
    if len(pairs) > _PAIRS_PER_AGGREGATE:
        return _pearson_products(df, list(columns), value)
    structs = []
    for a, b in pairs:
        x = F.when(value[b].isNotNull(), value[a])
        y = F.when(value[a].isNotNull(), value[b])
        r = F.try_divide(F.covar_samp(x, y), F.stddev(x) * F.stddev(y))
        structs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
    return df.agg(F.array(*structs).alias("p")).select(F.inline("p"))


def _pearson_products(df: DataFrame, columns: list[str], value: dict) -> DataFrame:
    """Pairwise-complete sums as matrix products. Values are centred first, so that large
    offsets cost no digits."""
    means = df.agg(*[F.avg(value[c]).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centred = df.select(*[(value[c] - F.lit(means[i] or 0.0)).alias(f"v{i}") for i, c in enumerate(columns)])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield product_sums((np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) for b in batches), len(columns))

    return correlations(centred.mapInArrow(products, PRODUCT_SUMS), columns)


PRODUCT_SUMS = "i long, j long, n double, x double, y double, xx double, yy double, xy double"


def product_sums(blocks: Iterable[np.ndarray], d: int) -> pa.RecordBatch:
    """Pairwise-complete sums of ``d`` columns over blocks of rows (NaN: missing), one row per pair."""
    upper = np.triu_indices(d, k=1)
    total = np.zeros((6, d, d))
    for x in blocks:
        here = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x, nan=0.0)
        total += [here.T @ here, x.T @ here, here.T @ x, (x * x).T @ here, here.T @ (x * x), x.T @ x]
    return pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), *[pa.array(t[upper]) for t in total]],
                                      names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])


def correlations(parts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, r)`` from the tasks' ``product_sums``."""
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    spread = lambda sq, v: F.col("n") * F.col(sq) - F.col(v) * F.col(v)
    # what is left of a constant column after rounding is not a spread
    real = lambda sq, v: F.when(spread(sq, v) > 1e-12 * F.col("n") * F.col(sq), spread(sq, v))
    r = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(real("xx", "x") * real("yy", "y"))
    names = F.array(*[F.lit(c) for c in columns])
    return s.select(F.element_at(names, F.col("i").cast("int") + 1).alias("a"), F.element_at(names, F.col("j").cast("int") + 1).alias("b"),
                    F.when((F.col("n") > 1) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def pearson_mae(real: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``pearson_corr_mae`` over the pairs defined on both sides (NULL if there is
    none or fewer than two numeric columns) and ``undefined_pairs``."""
    cols, _ = shared_columns(real, synth, columns)
    a, b = pearson_pairs(real, cols), pearson_pairs(synth, cols).withColumnRenamed("r", "s")
    gap = F.abs(F.col("r") - F.col("s"))
    return a.join(b, ["a", "b"]).agg(F.round(F.avg(gap), 6).alias("pearson_corr_mae"),
                                     F.count(F.when(gap.isNull(), 1)).alias("undefined_pairs"))


def pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]], side: str | None = None, keep_null: bool = False) -> DataFrame:
    """``(side, pair, a, b, n)``: contingency cells of column pairs. ``pair`` is the index in
    ``pairs``; ``side`` an optional whole-number column to split by.

    Without ``keep_null`` rows with a missing value in a pair are left out of that pair; with it a
    missing value counts as ``NULL_VALUE``.

    Each block of rows gets its values numbered once for every column. A pair's cells are then the distinct numbers
    (value of a, value of b), which is the product of the two columns' indicator matrices with only its filled cells.
    """
    used = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: i for i, c in enumerate(used)}
    slim = df.select((q(side) if side else F.lit(0)).cast("int").alias("side"), *[q(c).cast("string").alias(f"c{i}") for i, c in enumerate(used)])
    wanted = [(i, at[a], at[b]) for i, (a, b) in enumerate(pairs)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
                yield from _block_cells(pa.Table.from_batches(held), wanted, keep_null)
                held, rows, size = [], 0, 0
        if rows:
            yield from _block_cells(pa.Table.from_batches(held), wanted, keep_null)

    return slim.mapInArrow(count, "side int, pair int, a string, b string, n long").groupBy("side", "pair", "a", "b").agg(F.sum("n").alias("n"))


def _block_cells(block: pa.Table, wanted: list[tuple[int, int, int]], keep_null: bool) -> Iterator[pa.RecordBatch]:
    """The cells of all pairs in a block of rows, one batch for each side and pair."""
    for side in pc.unique(block["side"]).to_pylist():
        part = block.filter(pc.equal(block["side"], side))
        values, codes = [], []
        for column in part.columns[1:]:
            numbered = column.combine_chunks().dictionary_encode()
            here = numbered.indices.to_numpy(zero_copy_only=False)
            words = numbered.dictionary
            if numbered.null_count:
                here = np.where(np.isnan(here), len(words) if keep_null else -1, here)
                words = pa.concat_arrays([words, pa.array([NULL_VALUE], words.type)])
            values.append(words)
            codes.append(here.astype(np.int64))
        for k, i, j in wanted:
            cell = codes[i] * len(values[j]) + codes[j]
            if not keep_null:
                cell = cell[(codes[i] >= 0) & (codes[j] >= 0)]
            if not len(cell):
                continue
            space = len(values[i]) * len(values[j])
            if space <= 4 * len(cell):
                table = np.bincount(cell, minlength=space)
                found = np.flatnonzero(table)
                n = table[found]
            else:
                found, n = np.unique(cell, return_counts=True)
            a, b = values[i].take(pa.array(found // len(values[j]))), values[j].take(pa.array(found % len(values[j])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), side, np.int32)), pa.array(np.full(len(n), k, np.int32)), a, b, pa.array(n.astype(np.int64))],
                names=["side", "pair", "a", "b", "n"])


def pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]], side: str | None = None, keep_null: bool = False) -> DataFrame:
    """``pair_counts`` with the margins ``row_n`` and ``col_n`` of every cell."""
    cells = materialize(pair_counts(df, pairs, side, keep_null), "cells")   # read three times
    rows = cells.groupBy("side", "pair", "a").agg(F.sum("n").alias("row_n"))
    cols = cells.groupBy("side", "pair", "b").agg(F.sum("n").alias("col_n"))
    return cells.join(rows, ["side", "pair", "a"]).join(cols, ["side", "pair", "b"])


def pair_information(cells: DataFrame) -> DataFrame:
    """``(side, pair, mi)`` in nats from ``pair_counts``: log-sums of the cells and of both margins, without a join."""
    x = lambda c: F.sum(F.col(c) * F.log(c))
    keys = ["side", "pair"]
    joint = cells.groupBy(*keys).agg(F.sum("n").alias("total"), x("n").alias("l"))
    margins = cells.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("end"), F.col(c).alias("value"), "n") for c in "ab"])))
    sums = margins.groupBy(*keys, "end", "value").agg(F.sum("n").alias("m")).groupBy(*keys).agg(x("m").alias("m"))
    mi = (F.col("l") - F.col("m")) / F.col("total") + F.log("total")
    return joint.join(sums, keys).select(*keys, F.greatest(mi, F.lit(0.0)).alias("mi"))


def _pair_stats(cells: DataFrame) -> DataFrame:
    """Per (side, pair): V."""
    x = F.col("n") / F.col("row_n") * F.col("n") / F.col("col_n")
    sums = cells.groupBy("side", "pair").agg(
        F.sum(x).alias("s"))
    # a margin's distinct values: each row's cells weigh n / row_n, which adds up to one per value
    sizes = cells.groupBy("side", "pair").agg(
        F.round(F.sum(F.col("n") / F.col("row_n"))).cast("long").alias("rows"),
        F.round(F.sum(F.col("n") / F.col("col_n"))).cast("long").alias("cols"))
    joined = sums.join(sizes, ["side", "pair"])
    least = F.least("rows", "cols") - 1
    v = F.when(least > 0, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / least)).otherwise(0.0)
    return joined.select("side", "pair", v.alias("v"))


def _named_pairs(spark, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")


def cramers_v(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, v)`` for every pair of columns; 0 where a column is constant or empty."""
    pairs = list(combinations(columns, 2))
    stats = _pair_stats(pair_cells(nan_to_null(df), pairs)).drop("side")
    return _named_pairs(df.sparkSession, pairs).join(stats, "pair", "left") \
        .select("a", "b", F.coalesce("v", F.lit(0.0)).alias("v"))


def cramers_v_mae(real: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``cramers_v_mae`` over all pairs of label columns; NULL with fewer than two."""
    _, cols = shared_columns(real, synth, columns)
    pairs = list(combinations(cols, 2))
    spark = real.sparkSession
    if not pairs:
        return spark.sql("SELECT CAST(NULL AS DOUBLE) AS cramers_v_mae")
    both = real.select(F.lit(1).alias("__side"), *[q(c) for c in cols]) \
        .unionByName(synth.select(F.lit(0).alias("__side"), *[q(c) for c in cols]))
    stats = _pair_stats(pair_cells(both, pairs, "__side"))
    per_pair = stats.groupBy("pair").agg(F.sum(F.when(F.col("side") == 1, F.col("v"))).alias("r"),
                                         F.sum(F.when(F.col("side") == 0, F.col("v"))).alias("s"))
    gap = F.abs(F.coalesce("r", F.lit(0.0)) - F.coalesce("s", F.lit(0.0)))
    return _named_pairs(spark, pairs).join(per_pair, "pair", "left").agg(F.round(F.avg(gap), 6).alias("cramers_v_mae"))


def pairwise_mutual_information(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, mi)`` in nats for every pair; a missing value counts as a value."""
    pairs = list(combinations(columns, 2))
    stats = pair_information(materialize(pair_counts(df, pairs, keep_null=True), "cells")).drop("side")
    return _named_pairs(df.sparkSession, pairs).join(stats, "pair").select("a", "b", "mi")
