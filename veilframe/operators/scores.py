"""Scores of predictions, as aggregates over any prediction column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import running_totals
from ..functions.values import q
from ..session import materialize


def weighted_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: ``f1_weighted``, the F1 of each class weighted by its true rows (4 digits)."""
    cells = df.groupBy(q(label).alias("y"), q(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    truth = cells.groupBy("y").agg(F.sum("n").alias("support"),
                                   F.coalesce(F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))), F.lit(0)).alias("hits"))
    guesses = cells.groupBy("p").agg(F.sum("n").alias("guessed"))
    joined = truth.join(guesses, F.col("y") == F.col("p"), "left")
    f1 = 2.0 * F.col("hits") / (F.col("support") + F.coalesce("guessed", F.lit(0)))
    return joined.agg(F.round(F.sum(f1 * F.col("support")) / F.sum("support"), 4).alias("f1_weighted"))


def roc_auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """One row: ``roc_auc`` from ranks; ties count half, NULL if one side is empty."""
    counted = materialize(df.groupBy(q(score).cast("double").alias("score")).agg(
        F.sum(positive.cast("long")).alias("pos"), F.sum(1 - positive.cast("long")).alias("neg")), "scores")
    placed = running_totals(counted, "score", {"neg_before": "neg"})
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return placed.agg(F.round(F.try_divide(wins, F.sum("pos") * F.sum("neg")), 4).alias("roc_auc"))


def roc_auc_one_vs_rest(long: DataFrame) -> DataFrame:
    """One row: ``roc_auc`` of many classes, weighted by their true rows.

    ``long`` has ``(class, score, is_true)``: one row per row and class.
    """
    counted = materialize(long.groupBy("class", q("score").cast("double").alias("score")).agg(
        F.sum(F.col("is_true").cast("long")).alias("pos"), F.sum(1 - F.col("is_true").cast("long")).alias("neg")), "scores")
    placed = running_totals(counted, "score", {"neg_before": "neg"}, by="class")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    per_class = placed.groupBy("class").agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("n"))
    return per_class.agg(F.round(F.try_divide(F.sum(F.col("auc") * F.col("n")),
                                              F.sum(F.when(F.col("auc").isNotNull(), F.col("n")))), 4).alias("roc_auc"))


def regression_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: ``mae`` and ``r2`` (4 digits)."""
    y, p = q(label).cast("double"), q(prediction).cast("double")
    rest = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    return df.agg(F.round(F.avg(F.abs(y - p)), 4).alias("mae"), F.round(1 - F.try_divide(rest, spread), 4).alias("r2"))
