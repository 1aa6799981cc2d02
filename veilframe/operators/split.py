"""Exact-size sampling and holdout splits in a reproducible hash order.

Rows are ordered by a hash. A histogram of the hash (a few counts per group, all
combined map-side) tells in which hash bucket the cut falls; everything below it
is taken by a plain filter, and only the rows of that one bucket are ranked.
Nothing is sorted as a whole, and copies of one row are counted, not ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import HASH_SPACE, row_hash
from ..functions.ordered import dense_codes
from ..functions.values import q

_ROWS_PER_BUCKET = 4_000
_MAX_BUCKETS = 1 << 30


def _bucket_count(rows: int) -> int:
    return max(1, min(_MAX_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, rows) / _ROWS_PER_BUCKET)))))


def _take_lowest(df: DataFrame, order: Column, quota: DataFrame, group: str | None, rows: int) -> DataFrame:
    """Tag rows with ``__taken``: the ``__quota`` lowest rows of each group in hash order.

    ``quota`` has one row per group: the group column and ``__quota``.
    """
    cols = df.columns
    width = HASH_SPACE // _bucket_count(rows)
    keys = [F.lit(0).alias("__g")] if group is None else [q(group).alias("__g")]
    tagged = df.select("*", *keys, order.alias("__h")) \
        .withColumn("__b", F.floor(F.col("__h") / F.lit(width)))
    buckets = tagged.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__n"))
    running = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    cut = (buckets.withColumn("__upto", F.sum("__n").over(running))
           .join(quota, F.col("__g").eqNullSafe(F.col("__qg")))
           .where("__upto >= __quota AND __upto - __n < __quota")
           .select("__qg", F.col("__b").alias("__cut"), (F.col("__quota") - F.col("__upto") + F.col("__n")).alias("__left")))
    if group is None:  # one cut for the whole table: two numbers
        row = cut.first()
        at, left = (row["__cut"], row["__left"]) if row else (None, None)
        placed = tagged.withColumns({"__cut": F.lit(at).cast("long"), "__left": F.lit(left).cast("long")})
    else:
        placed = tagged.join(cut, F.col("__g").eqNullSafe(F.col("__qg")), "left")
    sure = placed.where("__cut IS NULL OR __b <> __cut") \
        .select(*[q(c) for c in cols], F.coalesce(F.col("__b") < F.col("__cut"), F.lit(False)).alias("__taken"))
    # the bucket with the cut: equal rows are folded into one with a count
    edge = placed.where("__b = __cut").groupBy(*[q(c) for c in cols], "__g", "__h", "__b", "__left") \
        .agg(F.count(F.lit(1)).alias("__copies"))
    ranked = Window.partitionBy("__g", "__b").orderBy("__h", *[q(c) for c in _orderable(df)]) \
        .rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("__left") - F.coalesce(F.sum("__copies").over(ranked), F.lit(0))
    split = edge.withColumn("__in", F.greatest(F.lit(0), F.least(room, F.col("__copies"))))
    parts = F.array(F.struct(F.lit(True).alias("t"), F.col("__in").alias("n")),
                    F.struct(F.lit(False).alias("t"), (F.col("__copies") - F.col("__in")).alias("n")))
    unfolded = (split.select(*[q(c) for c in cols], F.explode(parts).alias("__p")).where("__p.n > 0")
                .select(*[q(c) for c in cols], F.col("__p.t").alias("__taken"),
                        F.explode(F.sequence(F.lit(1), F.col("__p.n"))).alias("__i")).drop("__i"))
    return sure.unionByName(unfolded)


def _orderable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def sample_rows(df: DataFrame, n: int, seed: int = 42, order: Column | None = None, rows: int | None = None) -> DataFrame:
    """Exactly ``n`` rows without replacement; all rows if ``n`` is 0 or not smaller.

    ``rows`` saves counting when the size of ``df`` is known.
    """
    if n <= 0:
        return df
    rows = df.count() if rows is None else rows
    if n >= rows:
        return df
    spark = df.sparkSession
    quota = spark.createDataFrame([(0, n)], "__qg int, __quota long")
    hashed = order if order is not None else row_hash(df.columns, seed)
    return _take_lowest(df, hashed, quota, None, rows).where("__taken").drop("__taken")


def _check_share(holdout: float) -> None:
    if not 0.0 < holdout < 1.0:
        raise ValueError(f"holdout share must be inside (0, 1), got {holdout}")


def random_split(df: DataFrame, holdout: float = 0.2, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Add a ``split`` column: exactly ``ceil(holdout · n)`` rows are "holdout", the rest "train"."""
    _check_share(holdout)
    rows = df.count()
    quota = df.sparkSession.createDataFrame([(0, math.ceil(holdout * rows))], "__qg int, __quota long")
    hashed = order if order is not None else row_hash(df.columns, seed)
    return _named(_take_lowest(df, hashed, quota, None, rows))


def stratified_split(df: DataFrame, target: str, holdout: float = 0.2, seed: int = 42,
                     order: Column | None = None) -> DataFrame:
    """Add a ``split`` column keeping the class shares of ``target``.

    The holdout has exactly ``ceil(holdout · n)`` rows. Classes get the whole part
    of their share; the rows left over go to the largest remainders, ties to the
    smaller class value. A class with fewer than two rows is an error.
    """
    _check_share(holdout)
    sizes = df.groupBy(q(target).alias("__qg")).agg(F.count(F.lit(1)).alias("__n"))
    facts = sizes.agg(F.sum("__n").alias("rows"), F.min("__n").alias("least"), F.count(F.lit(1)).alias("classes")).first()
    rows = facts["rows"] or 0
    if facts["least"] is not None and facts["least"] < 2:
        raise ValueError(f"a class of {target!r} has fewer than two rows and cannot be split")
    wanted = math.ceil(holdout * rows)
    if rows and min(wanted, rows - wanted) < facts["classes"]:
        raise ValueError(f"{facts['classes']} classes do not fit into parts of {rows - wanted} and {wanted} rows")
    quota = class_quotas(sizes, wanted, rows)
    hashed = order if order is not None else row_hash(df.columns, seed)
    return _named(_take_lowest(df, hashed, quota, target, rows))


def class_quotas(sizes: DataFrame, wanted: int, rows: int) -> DataFrame:
    """Largest-remainder shares of ``wanted`` over classes ``(__qg, __n)``, in whole numbers.

    The ranking is over classes, by ranges of them.
    """
    whole = F.expr(f"(__n * {wanted}L) div {max(rows, 1)}L")
    rest = F.expr(f"(__n * {wanted}L) % {max(rows, 1)}L")
    parted = sizes.select("__qg", whole.alias("__w"), rest.alias("__r"))
    given = parted.agg(F.sum("__w").alias("w")).first()["w"] or 0
    if wanted == given:
        return parted.select("__qg", F.col("__w").alias("__quota"))
    place = F.struct((-F.col("__r")).alias("r"), F.col("__qg").alias("g"))
    ranked = dense_codes(parted.select(F.lit(0).alias("__all"), place.alias("__place")), "__all", "__place").select(
        F.col("__place.g").alias("__g"), "code")
    return parted.join(ranked, F.col("__qg").eqNullSafe(F.col("__g"))).select(
        "__qg", (F.col("__w") + F.when(F.col("code") < wanted - given, 1).otherwise(0)).alias("__quota"))


def _named(tagged: DataFrame) -> DataFrame:
    label = F.when(F.col("__taken"), "holdout").otherwise("train")
    return tagged.withColumn("split", label).drop("__taken")


def split_summary(tagged: DataFrame) -> DataFrame:
    """Rows per split."""
    return tagged.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
