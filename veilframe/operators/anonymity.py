"""k-anonymity, l-diversity and t-closeness from one pre-aggregate.

All of them start from ``(quasi-identifiers, sensitive value) → count``, which is
combined map-side; after that the work depends on the number of groups, not rows.
Rows with a missing quasi-identifier belong to no group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import nan_to_null, q


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def _cells(df: DataFrame, qi: Sequence[str], sensitive: str | None = None) -> DataFrame:
    """Counts per group, or per (group, sensitive value); group columns are g0, g1, …"""
    _require(df, [*qi, *([sensitive] if sensitive else [])])
    keys = [q(c).alias(f"g{i}") for i, c in enumerate(qi)]
    if sensitive:
        keys.append(q(sensitive).alias("sa"))
    slim = nan_to_null(df.select(*keys)).na.drop(subset=[f"g{i}" for i in range(len(qi))])
    return slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("n"))


def k_anonymity(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    """One row: ``k_anonymity``, the size of the smallest group (NULL without groups)."""
    return _cells(df, qi).agg(F.min("n").alias("k_anonymity"))


def k_violations(df: DataFrame, qi: Sequence[str], k: int) -> DataFrame:
    """Groups with fewer than ``k`` rows: the quasi-identifiers and ``count``."""
    return _cells(df, qi).where(F.col("n") < k).select(
        *[F.col(f"g{i}").alias(c) for i, c in enumerate(qi)], F.col("n").alias("count"))


def l_diversity(df: DataFrame, qi: Sequence[str], sensitive: str) -> DataFrame:
    """One row: ``l_diversity``, the smallest number of distinct sensitive values in a group."""
    groups = [f"g{i}" for i in range(len(qi))]
    return (_cells(df, qi, sensitive).groupBy(*groups).agg(F.count("sa").alias("l"))
            .agg(F.min("l").alias("l_diversity")))


def _global_shares(reference: DataFrame, sensitive: str) -> DataFrame:
    """``(sa, q)``: share of each sensitive value in the reference, missing values left out."""
    _require(reference, [sensitive])
    counts = nan_to_null(reference.select(q(sensitive).alias("sa"))).where("sa IS NOT NULL") \
        .groupBy("sa").agg(F.count(F.lit(1)).alias("m"))
    return counts.select("sa", (F.col("m") / counts.agg(F.sum("m")).scalar()).alias("q"))


def group_distances(df: DataFrame, qi: Sequence[str], sensitive: str, reference: DataFrame,
                    global_values_only: bool = False) -> DataFrame:
    """Per group: ``n`` rows, ``l`` distinct sensitive values and ``t``, the total-variation
    distance between the group's sensitive values and the reference's.

    Only present cells are joined: values a group lacks add their reference share,
    which is one minus the shares of the values it has.
    ``global_values_only`` leaves out values the reference does not have.
    """
    groups = [f"g{i}" for i in range(len(qi))]
    cells = _cells(df, qi, sensitive)
    joined = cells.join(_global_shares(reference, sensitive), "sa", "left")
    # p needs the group's total; Σ|p − q| is split by the sign of p − q after a second aggregate
    totals = cells.where("sa IS NOT NULL").groupBy(*groups).agg(F.sum("n").alias("total"))
    placed = joined.join(totals, groups, "left")
    share: Column = F.col("n") / F.col("total")
    present = F.col("sa").isNotNull()
    counted = present & F.col("q").isNotNull() if global_values_only else present
    per_group = placed.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.count("sa").alias("l"),
        F.sum(F.when(counted, F.abs(share - F.coalesce("q", F.lit(0.0))))).alias("moved"),
        F.sum(F.when(present, F.col("q"))).alias("covered"))
    t = F.lit(0.5) * (F.coalesce("moved", F.lit(0.0)) + F.lit(1.0) - F.coalesce("covered", F.lit(0.0)))
    return per_group.select(*[F.col(f"g{i}").alias(c) for i, c in enumerate(qi)], "n", "l", t.alias("t"))


def t_closeness(df: DataFrame, qi: Sequence[str], sensitive: str, reference: DataFrame,
                global_values_only: bool = False) -> DataFrame:
    """One row: ``t_closeness``, the largest group distance, rounded to 6 digits.

    The distance is total variation, also for numeric sensitive columns.
    """
    per_group = group_distances(df, qi, sensitive, reference, global_values_only)
    return per_group.agg(F.round(F.greatest(F.max("t"), F.lit(0.0)), 6).alias("t_closeness"))


def classical_metrics(df: DataFrame, qi: Sequence[str], sensitive: str, reference: DataFrame) -> DataFrame:
    """One row with k_anonymity, l_diversity and t_closeness."""
    return group_distances(df, qi, sensitive, reference).agg(
        F.min("n").alias("k_anonymity"), F.min("l").alias("l_diversity"),
        F.round(F.greatest(F.max("t"), F.lit(0.0)), 6).alias("t_closeness"))


def check_klt(df: DataFrame, qi: Sequence[str], sensitive: str, reference: DataFrame,
              k: int, l: int, t: float) -> DataFrame:  # noqa: E741
    """One row: the three metrics and ``passed`` = k and l reached, t below its limit."""
    per_group = group_distances(df, qi, sensitive, reference, global_values_only=True)
    metrics = per_group.agg(F.min("n").alias("k_anonymity"), F.min("l").alias("l_diversity"),
                            F.max("t").alias("t_closeness"))
    return metrics.select("k_anonymity", "l_diversity", F.round("t_closeness", 6).alias("t_closeness"),
                          ((F.col("k_anonymity") >= k) & (F.col("l_diversity") >= l)
                           & (F.col("t_closeness") < t)).alias("passed"))
