"""Exact quantiles of many columns without gathering a column in one task.

``percentile`` and ``median`` keep every distinct value of a column in one
reducer. Here a sketch first gives a narrow bracket around each wanted rank,
one aggregate counts what lies below and inside the brackets, and only the
pre-aggregated values inside the brackets are ranked. The counts prove that the
rank is in its bracket, so the result is exact; brackets still too full are
narrowed again.

With weights, the sketch cuts the rows of a bracket and not their weight: the
weight of every slot between two cuts, and of the cuts themselves, is summed, and
the slot that holds the rank is the next bracket. So a bracket always gets fewer
rows, however the weight lies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .values import as_number, q

SKETCH_ACCURACY = 5_000
RANK_LIMIT = 1_000_000  # values one ranking task may be given
SLOTS = 64              # pieces that a bracket of weighted rows is cut into


@dataclass
class _Target:
    column: str
    rank: int           # 0-based rank among the non-null values
    low: float
    high: float
    below: int          # values smaller than `low`, weighted
    inside: int         # values in [low, high], weighted
    rows: int           # rows with a value in [low, high]


def exact_quantiles(df: DataFrame, probs: dict[str, list[float]], weight: str | dict[str, str] | None = None,
                    facts: dict[str, dict] | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles, the definition of numpy and ``percentile``.

    ``weight`` names an integer column (or one per column): each row then stands for
    that many copies. A ``facts`` dictionary is filled with ``n, min, max, mean, std``
    of every column, which the first pass knows anyway (``std`` is not weighted).
    """
    if not probs:
        return {}
    cols = list(probs)
    weights = weight if isinstance(weight, dict) else dict.fromkeys(cols, weight)
    index = {c: f"v{i}" for i, c in enumerate(cols)}
    copies = {c: f"w{sorted({w or '' for w in weights.values()}).index(weights[c] or '')}" for c in cols}
    base = df.select(*[as_number(c, df.schema[c].dataType).alias(index[c]) for c in cols],
                     *[(q(name) if name else F.lit(1)).cast("long").alias(f"w{k}")
                       for k, name in enumerate(sorted({w or "" for w in weights.values()}))])
    base = base.select(*[F.when(F.col(copies[c]) > 0, F.col(index[c])).alias(index[c]) for c in cols],
                       *sorted(set(copies.values())))
    first = base.agg(*[e for c in cols for v, w in [(F.col(index[c]), F.col(copies[c]))] for e in (
        F.sum(F.when(v.isNotNull(), w)).alias(f"n_{index[c]}"), F.count(v).alias(f"r_{index[c]}"), F.min(v).alias(f"lo_{index[c]}"), F.max(v).alias(f"hi_{index[c]}"),
        *([(F.sum(v * w)).alias(f"m_{index[c]}"), F.stddev(v).alias(f"s_{index[c]}")] if facts is not None else []))]).first()
    targets: dict[tuple[str, int], _Target] = {}
    for c in cols:
        v = index[c]
        n = first[f"n_{v}"] or 0
        if facts is not None:
            facts[c] = {"n": n, "min": first[f"lo_{v}"], "max": first[f"hi_{v}"], "std": first[f"s_{v}"],
                        "mean": first[f"m_{v}"] / n if n else None}
        for p in probs[c] if n else []:
            for rank in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}:
                targets[(c, rank)] = _Target(c, rank, first[f"lo_{v}"], first[f"hi_{v}"], 0, n, first[f"r_{v}"])

    margin = 4.0 / SKETCH_ACCURACY
    # a bracket of one single value needs no ranking, however many rows hold it
    uneven = [t for t in targets.values() if weights[t.column]]
    while uneven := [t for t in uneven if t.rows > RANK_LIMIT and t.low < t.high]:
        _narrow_weighted(base, index, copies, uneven)
    crowded = [t for t in targets.values() if not weights[t.column] and t.inside > RANK_LIMIT and t.low < t.high]
    while crowded and margin < 0.5:
        if not _narrow(base, index, copies, crowded, margin):
            margin *= 8
        crowded = [t for t in crowded if t.inside > RANK_LIMIT and t.low < t.high]

    ranked = _pick(base, index, copies, list(targets.values()))
    result: dict[str, list[float | None]] = {}
    for c in cols:
        n = first[f"n_{index[c]}"] or 0
        out: list[float | None] = []
        for p in probs[c]:
            if not n:
                out.append(None)
                continue
            pos = p * (n - 1)
            low = ranked[(c, math.floor(pos))]
            high = ranked[(c, math.ceil(pos))]
            out.append(low + (high - low) * (pos - math.floor(pos)))
        result[c] = out
    return result


def _narrow(base: DataFrame, index: dict[str, str], copies: dict[str, str], crowded: list[_Target], margin: float) -> bool:
    """One sketch pass and one counting pass; True if some bracket became smaller."""
    # targets that still share a bracket share its sketch
    shared: dict[tuple, list[_Target]] = {}
    for t in crowded:
        shared.setdefault((t.column, t.low, t.high), []).append(t)
    sketches = []
    for b, ((column, low, high), group) in enumerate(shared.items()):
        v = F.col(index[column])
        points = [x for t in group for place in [(t.rank - t.below) / t.inside]
                  for x in (max(0.0, place - margin), min(1.0, place + margin))]
        sketches.append(F.percentile_approx(F.when((v >= low) & (v <= high), v), points, SKETCH_ACCURACY).alias(f"b{b}"))
    row = base.agg(*sketches).first()
    found = {id(t): row[f"b{b}"][2 * k:2 * k + 2] for b, group in enumerate(shared.values()) for k, t in enumerate(group)}
    counts = []
    for i, t in enumerate(crowded):
        v, w = F.col(index[t.column]), F.col(copies[t.column])
        low, high = found[id(t)]
        counts.append(F.sum(F.when(v < low, w).otherwise(0)).alias(f"u{i}"))
        counts.append(F.sum(F.when((v >= low) & (v <= high), w).otherwise(0)).alias(f"c{i}"))
    seen = base.agg(*counts).first()
    smaller = False
    for i, t in enumerate(crowded):
        below, inside = seen[f"u{i}"], seen[f"c{i}"]
        low, high = found[id(t)]
        if below <= t.rank < below + inside and (inside < t.inside or low == high):
            smaller = True
            t.low, t.high, t.below, t.inside = low, high, below, inside
    return smaller


def _slot(cuts: Column, value: Column) -> Column:
    """Odd slots are the cuts, even ones lie between them."""
    return F.size(F.filter(cuts, lambda c: c < value)) * 2 + F.array_contains(cuts, value).cast("int")


def _narrow_weighted(base: DataFrame, index: dict[str, str], copies: dict[str, str], crowded: list[_Target]) -> None:
    """Cut the rows of each bracket and keep the slot that holds the weighted rank: fewer rows, or one single value."""
    shared: dict[tuple, list[_Target]] = {}
    for t in crowded:
        shared.setdefault((t.column, t.low, t.high), []).append(t)
    values = [F.when(F.col(index[column]).between(low, high), F.col(index[column])) for column, low, high in shared]
    points = [i / SLOTS for i in range(SLOTS + 1)]
    sketch = base.agg(*[F.percentile_approx(v, points, SKETCH_ACCURACY).alias(f"b{b}") for b, v in enumerate(values)]).first()
    entries = []
    for b, ((column, _, _), v) in enumerate(zip(shared, values)):
        cuts = F.expr("array(" + ", ".join(f"double('{x!r}')" for x in sorted(set(sketch[f"b{b}"]))) + ")")
        slot = _slot(cuts, v)
        entries.append(F.when(v.isNotNull(), F.struct(F.lit(b).alias("b"), slot.alias("slot"), v.alias("v"), F.col(copies[column]).alias("w"))))
    found = (base.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.b", "e.slot")
             .agg(F.sum("e.w").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("e.v").alias("low"), F.max("e.v").alias("high"))
             .orderBy("b", "slot").collect())  # at most 2 SLOTS + 3 rows per bracket
    for b, group in enumerate(shared.values()):
        below = group[0].below
        for r in found:
            if r["b"] != b:
                continue
            for t in group:
                if below <= t.rank < below + r["n"]:
                    t.low, t.high, t.below, t.inside, t.rows = r["low"], r["high"], below, r["n"], r["rows"]
            below += r["n"]


def _pick(base: DataFrame, index: dict[str, str], copies: dict[str, str],
          targets: list[_Target]) -> dict[tuple[str, int], float]:
    """Values at the wanted ranks; each bracket is ranked over its distinct values."""
    answer = {(t.column, t.rank): t.low for t in targets if t.low == t.high}
    todo = [t for t in targets if t.low < t.high]
    if not todo:
        return answer
    brackets: dict[tuple[str, float, float], list[_Target]] = {}
    for t in todo:
        brackets.setdefault((t.column, t.low, t.high), []).append(t)
    entries, wanted = [], []
    for b, ((column, low, high), group) in enumerate(brackets.items()):
        v = F.col(index[column])
        entries.append(F.when((v >= low) & (v <= high),
                              F.struct(F.lit(b).alias("b"), v.alias("v"), F.col(copies[column]).alias("w"))))
        wanted += [(b, t) for t in group]
    counted = (base.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
               .groupBy("e.b", "e.v").agg(F.sum("e.w").alias("n")))
    running = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.sum("n").over(running))
    hit = F.lit(False)
    for b, t in wanted:
        offset = t.rank - t.below
        hit = hit | ((F.col("b") == b) & (F.col("upto") > offset) & (F.col("upto") - F.col("n") <= offset))
    rows = placed.where(hit).collect()  # at most one row per wanted rank
    for b, t in wanted:
        offset = t.rank - t.below
        for r in rows:
            if r["b"] == b and r["upto"] - r["n"] <= offset < r["upto"]:
                answer[(t.column, t.rank)] = r["v"]
    return answer


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in cols}).items()}
