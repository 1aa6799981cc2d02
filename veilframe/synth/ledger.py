"""Privacy budget: conversions and the running account (zero-concentrated DP)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import sums_upto
from ..functions.values import q


def default_delta(rows: int) -> float:
    """1 / (n · √n)."""
    return 1.0 / (rows * math.sqrt(rows))


def default_delta_frame(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and ``delta`` of a table."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), F.try_divide(F.lit(1.0), n * F.sqrt(n)).alias("delta"))


def epsilon_of(rho: float, delta: float) -> float:
    return rho + 2.0 * math.sqrt(rho * math.log(1.0 / delta))


def rho_of(epsilon: float, delta: float) -> float:
    """The largest rho whose epsilon stays within ``epsilon``."""
    log = math.log(1.0 / delta)
    return (math.sqrt(log + epsilon) - math.sqrt(log)) ** 2 * (1 - 1e-9)  # room for rounding


def budget_ledger(releases: DataFrame) -> DataFrame:
    """Add ``rho_spent`` and ``epsilon_spent`` to releases ``(run_id, step, rho, delta[, epsilon])``.

    ``epsilon`` holds the cost of pure-DP releases, which adds up as it is. Running sums are made over stretches of a run, so a run
    may have any number of releases; of releases with equal ``step`` the order is that of their costs.
    """
    pure = "epsilon" in releases.columns
    order = [F.col(c).asc() for c in ("step", "rho", *(["epsilon"] if pure else []))]
    summed = sums_upto(releases, ["run_id"], order, {"rho_spent": "rho", **({"__pure": "epsilon"} if pure else {})})
    spent = (F.col("__pure") if pure else F.lit(0.0)) + F.col("rho_spent") + 2 * F.sqrt(F.col("rho_spent") * F.log(1 / F.col("delta")))
    return summed.select(*[q(c) for c in releases.columns], "rho_spent", spent.alias("epsilon_spent"))


def estimate_max_steps(history: DataFrame, budget: float) -> DataFrame:
    """Per run, how many steps the budget allows at the average cost seen so far:
    ``(run_id, max_steps)`` from ``(run_id, step, epsilon)``; NULL without a cost."""
    per_step = F.try_divide(F.max("epsilon"), F.max("step"))
    return history.groupBy("run_id").agg(F.floor(F.try_divide(F.lit(float(budget)), per_step)).alias("max_steps"))
