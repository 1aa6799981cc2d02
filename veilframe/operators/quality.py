"""One overall quality score from published statistics: column shapes and pair trends."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import running_totals
from ..functions.values import as_number, q
from ..session import materialize
from .association import pair_counts, pearson_pairs
from .marginals import _sides, shared_columns, tvd_categorical

PAIR_BINS = 10


def ks_numeric(real: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, ks)``: two-sample Kolmogorov-Smirnov statistic of every numeric column."""
    cols, _ = shared_columns(real, synth, columns)
    counts = materialize(_sides(real, synth, cols, "double").where("value IS NOT NULL").groupBy("column", "value").agg(
        F.sum("is_real").alias("r"), F.sum(1 - F.col("is_real")).alias("s")), "ecdf")
    totals = counts.groupBy("column").agg(F.sum("r").alias("nr"), F.sum("s").alias("ns"))
    placed = running_totals(counts, "value", {"rb": "r", "sb": "s"}, by="column").join(F.broadcast(totals), "column")
    gap = F.abs(F.try_divide(F.col("rb") + F.col("r"), F.col("nr")) - F.try_divide(F.col("sb") + F.col("s"), F.col("ns")))
    return placed.groupBy("column").agg(F.max(gap).alias("ks"))


def column_shapes(real: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, score)``: 1 − KS of numbers, 1 − total variation of labels."""
    numbers, labels = shared_columns(real, synth, columns)
    parts = []
    if numbers:
        parts.append(ks_numeric(real, synth, columns).select("column", (1 - F.col("ks")).alias("score")))
    if labels:
        parts.append(tvd_categorical(real, synth, columns).select("column", (1 - F.col("tvd")).alias("score")))
    if not parts:
        return real.sparkSession.createDataFrame([], "column string, score double")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def pair_trends(real: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(a, b, score)``: 1 − |Δr|/2 for two numbers; otherwise 1 − total variation of the pair
    table, a number being cut into ten equal bins of the real range."""
    numbers, labels = shared_columns(real, synth, columns)
    spark = real.sparkSession
    out = pearson_pairs(real, numbers).join(pearson_pairs(synth, numbers).withColumnRenamed("r", "s"), ["a", "b"]) \
        .select("a", "b", (1 - F.abs(F.col("r") - F.col("s")) / 2).alias("score"))
    pairs = list(combinations(labels, 2)) + [(c, n) for c in labels for n in numbers]
    if not pairs:
        return out
    spans = real.agg(*[e for i, n in enumerate(numbers) for e in (
        F.min(as_number(n, real.schema[n].dataType)).alias(f"lo{i}"),
        F.max(as_number(n, real.schema[n].dataType)).alias(f"hi{i}"))]).first() if numbers else None

    def coarse(d: DataFrame, side: int) -> DataFrame:
        cut = []
        for i, n in enumerate(numbers):
            low, high = spans[f"lo{i}"] or 0.0, spans[f"hi{i}"] or 0.0
            x = as_number(n, d.schema[n].dataType)
            place = F.floor((x - low) / (((high - low) or 1.0) / PAIR_BINS))
            inside = F.least(place, F.lit(PAIR_BINS - 1))
            cut.append(F.when(x < low, -1).when(x > high, PAIR_BINS).when(x.isNotNull(), inside).cast("string").alias(n))
        return d.select(F.lit(side).alias("__side"), *[q(c).cast("string").alias(c) for c in labels], *cut)

    cells = pair_counts(coarse(real, 1).unionByName(coarse(synth, 0)), pairs, "__side") \
        .groupBy("pair", "a", "b").agg(F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("r"),
                                       F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("s"))
    cells = materialize(cells, "cells")     # read twice
    totals = cells.groupBy("pair").agg(F.sum("r").alias("nr"), F.sum("s").alias("ns"))
    gap = F.abs(F.coalesce(F.try_divide("r", "nr"), F.lit(0.0)) - F.coalesce(F.try_divide("s", "ns"), F.lit(0.0)))
    tvd = cells.join(F.broadcast(totals), "pair").groupBy("pair").agg((1 - F.sum(gap) / 2).alias("score"))  # one row per pair
    names = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return out.unionByName(names.join(tvd, "pair").select("a", "b", "score"))


def quality_score(real: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: overall_score, column_shapes_score, column_pair_trends_score (4 digits)."""
    shapes = column_shapes(real, synth, columns).select(F.lit("s").alias("k"), "score")
    trends = pair_trends(real, synth, columns).select(F.lit("t").alias("k"), "score")
    means = shapes.unionByName(trends).agg(F.avg(F.when(F.col("k") == "s", F.col("score"))).alias("s"),
                                           F.avg(F.when(F.col("k") == "t", F.col("score"))).alias("t"))
    overall = (F.coalesce("s", "t") + F.coalesce("t", "s")) / 2
    return means.select(F.round(overall, 4).alias("overall_score"), F.round("s", 4).alias("column_shapes_score"),
                        F.round("t", 4).alias("column_pair_trends_score"))
