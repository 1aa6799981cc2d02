"""Sampling a tree under a condition without drawing in vain: messages up the tree, draws down.

The parts of a condition that look at one column give each token of that column a weight: the share of its values that pass.
From the leaves up, a column tells its parent how likely each parent token leads to values that pass (a sum over the
column's tokens). The tree with these factors put in is again a tree: its root is drawn with its share of passing rows, and every
column given its parent, so rows that cannot pass are never drawn. Parts that look at several columns are left to rejection.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import uniform
from ..session import materialize
from .tokens import ColumnSpec, detokenize

PLACES = 1024       # at which a bin is tried, to see what share of it passes
CANDIDATES = 64     # values drawn inside a bin that passes in part
SCALE = 1 << 40     # conditional shares are kept in so many parts of one


def column_predicates(spark: SparkSession, specs: list[ColumnSpec], condition: str) -> dict[str, str]:
    """The parts of a condition, joined by AND, that look at one column only: column → predicate."""
    empty = spark.createDataFrame([], ", ".join(f"`{s.name}` {s.type}" for s in specs)).where(condition)
    names, found, todo = {s.name for s in specs}, {}, [empty._jdf.queryExecution().analyzed().condition()]
    while todo:
        part = todo.pop()
        if part.getClass().getSimpleName() == "And":
            todo += [part.left(), part.right()]
            continue
        used, seen = set(), part.references().iterator()
        while seen.hasNext():
            used.add(seen.next().name())
        if len(used) == 1 and used <= names and part.deterministic() and "subquery" not in part.sql().lower():
            found.setdefault(used.pop(), []).append(part.sql())
    return {c: " AND ".join(f"({p})" for p in parts) for c, parts in found.items()}


def token_weights(tokens: DataFrame, spec: ColumnSpec, predicate: str) -> DataFrame:
    """``(token, w)``: the share of a token's values that pass."""
    tried = tokens.select("token", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("__k")) if spec.continuous else tokens.withColumn("__k", F.lit(0))
    valued = tried.select("token", detokenize(F.col("token"), spec, (F.col("__k") + 0.5) / PLACES).alias(spec.name))
    return valued.select("token", F.coalesce(F.expr(predicate).cast("double"), F.lit(0.0)).alias("w")).groupBy("token").agg(F.avg("w").alias("w"))


def conditioned(model, predicates: dict[str, str]):
    """The model given the predicates, and the share of its rows that pass them."""
    specs = {s.name: s for s in model.specs}
    messages: dict[str, DataFrame] = {}
    changed: list[DataFrame] = []
    share = 1.0
    for column, parent in reversed(model.order):
        mine = model.cells.where(F.col("target") == column)
        factors = [messages[child] for child, p in model.order if p == column and child in messages]
        if column in predicates:
            factors.append(token_weights(mine.select("token").distinct(), specs[column], predicates[column]))
        if not factors:
            continue
        factors = [f.withColumnRenamed("w", f"__w{i}") for i, f in enumerate(factors)]
        known = reduce(lambda a, b: a.join(b, "token"), factors)
        weight = reduce(lambda a, b: a * b, [F.col(f"__w{i}") for i in range(len(factors))])
        mass = materialize(mine.join(known.select("token", weight.alias("w")), "token").where("w > 0 AND b > a")
                           .select("target", "parent_token", "token", ((F.col("b") - F.col("a")) * F.col("w")).alias("mass")), "mass")
        totals = mass.groupBy("parent_token").agg(F.sum("mass").alias("w"))
        changed.append(mass.join(totals, "parent_token").select(
            "target", "parent_token", "token", F.greatest(F.lit(1), F.round(F.col("mass") / F.col("w") * SCALE)).cast("long").alias("n")))
        if parent is None:
            share *= totals.agg(F.sum("w")).first()[0] or 0.0
        else:
            messages[column] = totals.withColumnRenamed("parent_token", "token")
    if not changed or not share:
        return model, share
    from .model import intervals, slot_counts

    given = materialize(reduce(DataFrame.unionByName, changed), "given")
    touched = [r["target"] for r in given.select("target").distinct().collect()]    # one row per column
    cells = materialize(model.cells.where(~F.col("target").isin(touched)).select("target", "parent_token", "token", "a", "b")
                        .unionByName(intervals(given)), "model")
    return replace(model, cells=cells, slots=slot_counts(cells)), share


def candidates(token: Column, spec: ColumnSpec, seed: int, row: str) -> Column:
    """Values of the token's bin for a row; the first that passes is taken."""
    return F.transform(F.sequence(F.lit(0), F.lit(CANDIDATES - 1)), lambda k: detokenize(token, spec, uniform(seed, "v", spec.name, F.col(row), k)))


def first_passing(held: str, name: str, predicate: str) -> Column:
    """Of an array column, the first value that passes; null if none does."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.expr(f"get(filter(`{held}`, {quoted} -> {predicate}), 0)")
