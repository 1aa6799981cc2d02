"""Whole-table ordered computations (running totals, carry-forward) without a
single-task window: values are cut into ranges, ranges are summarised, and the
window runs inside each range only."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .values import q

RANGES = 256  # a power of two
PAGE_ROWS = 100_000  # beyond so many rows, a page is found by numbering


def ordered_ranges(df: DataFrame, order: str, out: str, by: str | None = None) -> DataFrame:
    """Tag rows with an ascending range number of a numeric column, from a sketch of it.

    With ``by`` (a column with few values, such as a column name or a class) every
    group gets ranges of its own. The cuts go to the rows: a join that deals rows by a column of few
    values would bring a whole group into one task.
    """
    points = [i / RANGES for i in range(1, RANGES)]
    sketch = F.percentile_approx(q(order), points, 10_000)
    if by:
        cuts = df.groupBy(q(by).alias("__by")).agg(sketch.alias("__cuts"))
        placed = df.join(F.broadcast(cuts), q(by) == F.col("__by")).withColumn(out, F.lit(0))
        step = RANGES // 2
        while step:  # binary search in the sorted cuts, as plain column expressions
            nth = F.element_at("__cuts", F.col(out) + step)
            placed = placed.withColumn(out, F.col(out) + F.when(nth <= q(order), step).otherwise(0))
            step //= 2
        return placed.select(*[q(c) for c in df.columns], out)
    edges = sorted(set(df.agg(sketch.alias("p")).first()["p"] or []))
    splits = [float("-inf"), *[float(e) for e in edges], float("inf")]
    tagged = Bucketizer(splits=splits, inputCol="__ord", outputCol=out, handleInvalid="error") \
        .transform(df.withColumn("__ord", q(order).cast("double")))
    return tagged.drop("__ord").withColumn(out, F.col(out).cast("int"))


def running_totals(df: DataFrame, order: str, totals: dict[str, str], by: str | None = None) -> DataFrame:
    """Add, per row, the sum over all rows with a strictly smaller ``order`` value.

    ``df`` has one row per ``order`` value (per ``by`` group): pre-aggregate first.
    ``totals`` maps a new column name to the summed column.
    """
    keys = [by] if by else []
    ranged = ordered_ranges(df, order, "__range", by)
    # at most RANGES rows per group
    sums = ranged.groupBy(*keys, "__range").agg(*[F.sum(q(c)).alias(f"__s_{n}") for n, c in totals.items()])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__range", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__s_{n}")
                                             for n in totals])
    inner = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts if by else F.broadcast(starts)  # at most RANGES rows
    return (ranged.join(starts, [*keys, "__range"])
            .select(*df.columns,
                    *[(F.coalesce(F.sum(q(c)).over(inner), F.lit(0)) + F.col(f"__s_{n}")).alias(n)
                      for n, c in totals.items()]))


def dense_codes(values: DataFrame, group: str, value: str) -> DataFrame:
    """Number the distinct values of each group 0, 1, … in ascending order: ``(group, value, code)``.

    Values are sorted over many tasks; each task numbers its own stretch and adds
    the number of smaller values held by the tasks before it.
    """
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stretched = materialize(
        values.select(q(group), q(value)).where(q(value).isNotNull()).distinct()
        .repartitionByRange(parts, group, value).withColumn("__part", F.spark_partition_id()), "codes")
    sizes = stretched.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__part").orderBy(value)
    return stretched.join(starts, [group, "__part"]).select(
        group, value, (F.col("__start") + F.row_number().over(inside) - 1).alias("code"))


def carry_forward(df: DataFrame, group: list[str], position: str, values: dict[str, Column],
                  chunk_rows: int = 100_000) -> DataFrame:
    """Last non-null value at or before each row, per group in ``position`` order.

    A group of any size is cut into chunks of ``chunk_rows`` positions, so a log
    file that holds a third of all lines is still spread over many tasks.
    """
    names = list(values)
    cut = df.withColumns({n: c for n, c in values.items()}) \
        .withColumn("__chunk", F.floor(q(position) / F.lit(chunk_rows)))
    keys = [*group, "__chunk"]
    ends = cut.groupBy(*keys).agg(*[
        F.max_by(q(n), F.when(q(n).isNotNull(), q(position))).alias(f"__e_{n}") for n in names])
    over_chunks = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, *[F.last(f"__e_{n}", ignorenulls=True).over(over_chunks).alias(f"__c_{n}")
                                  for n in names])
    inside = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.last(q(n), ignorenulls=True).over(inside).alias(f"__l_{n}") for n in names])
    joined = local.join(starts, keys, "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n in names])


def _segments(df: DataFrame, keys: list[str], order: list[Column], label: str) -> DataFrame:
    """``df`` sorted by keys and order over many tasks and written, with ``__part`` and the place ``__at`` in the whole order.

    A key of any size is cut where a task ends; rows alike in keys and order may be cut, too.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = "__row"   # so that rows that are alike don't crowd one range
    salted = df.withColumn(row, F.monotonically_increasing_id())
    by = [*[q(k) for k in keys], *order, F.col(row)]
    return materialize(salted.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(row)
                       .withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), label)


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Number the rows of each key 1, 2, … in ``order``; no task holds all rows of a frequent key."""
    cut = _segments(df, keys, order, "numbered")
    spans = cut.groupBy(*[q(k) for k in keys], "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*[q(k) for k in keys]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = spans.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"),
                          (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    same = (F.col("__part") == F.col("__p"))
    for i, k in enumerate(keys):
        same = same & q(k).eqNullSafe(F.col(f"__k{i}"))
    return cut.join(starts, same).select(*[q(c) for c in df.columns], (F.col("__at") + F.col("__shift") + 1).alias(out))


def sums_upto(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, str]) -> DataFrame:
    """Per row, the sums over the rows of its key up to and including it, in ``order``; ``totals`` maps a new column to the summed one.

    Sums are made in two levels, over the stretch of a key that a task holds and over its stretches, so no task holds all rows of a
    frequent key.
    """
    cut = _segments(df, keys, order, "sums")
    by = [q(k) for k in keys]
    stretches = cut.groupBy(*by, "__part").agg(*[F.sum(q(c)).alias(f"__s_{n}") for n, c in totals.items()])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)   # a row for each part
    starts = stretches.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"),
                              *[F.sum(f"__s_{n}").over(before).alias(f"__b_{n}") for n in totals])
    inside = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"__l_{n}": F.sum(q(c)).over(inside) for n, c in totals.items()})
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & q(k).eqNullSafe(F.col(f"__k{i}"))
    return local.join(starts, same).select(*[q(c) for c in df.columns], *[F.coalesce(F.col(f"__b_{n}") + F.col(f"__l_{n}"), f"__b_{n}", f"__l_{n}").alias(n) for n in totals])


def page_of(df: DataFrame, order: list[Column], start: int, rows: int) -> DataFrame:
    """Rows ``start`` to ``start + rows`` of the whole order, in order.

    Near the beginning every task keeps its first rows only. Further down rows are numbered over many tasks, so that no task
    holds all that comes before the page.
    """
    if start + rows <= PAGE_ROWS:
        return df.orderBy(*order).offset(start).limit(rows)
    return numbered(df, [], order, "__place").where(F.col("__place").between(start + 1, start + rows)).orderBy("__place").drop("__place")


def paged(df: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    """One page of a listing, with ``page, per_page, total, pages`` on every row."""
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (page_of(df, order, (page - 1) * per_page, per_page)
            .withColumns({"page": F.lit(page), "per_page": F.lit(per_page), "total": total})
            .withColumn("pages", F.ceil(F.col("total") / per_page)))
