"""Profiles and summaries, in long form: one row per column (and value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.quantiles import exact_quantiles
from ..functions.values import as_number, is_numeric, nan_to_null, q
from .roles import ColumnRoles


def _long(df: DataFrame, columns: list[str], as_type: str, name: str = "value") -> DataFrame:
    """``(column, value)`` rows of the given columns, in one pass."""
    if as_type == "double":
        wide = df.select(*[as_number(c, df.schema[c].dataType).alias(c) for c in columns])
    else:
        wide = df.select(*[q(c).cast(as_type).alias(c) for c in columns])
    if len(columns) == 1:
        return wide.select(F.lit(columns[0]).alias("column"), q(columns[0]).alias(name))
    return wide.unpivot([], [q(c) for c in columns], "column", name)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, count)`` of several columns in one shuffle; values as text, NULL kept."""
    return _long(nan_to_null(df), columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """Relative frequency of every non-null value: ``(column, value, frequency)``."""
    counts = value_counts(df, columns).where("value IS NOT NULL")
    totals = counts.groupBy("column").agg(F.sum("count").alias("total"))
    return (counts.join(F.broadcast(totals), "column")  # one row per column
            .select("column", "value", (F.col("count") / F.col("total")).alias("frequency")))


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per column, ties to the smaller value.

    The rank filter is applied before the shuffle too, so at most ``k`` rows per
    column leave each task.
    """
    order = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def profile_continuous(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Per continuous column: null_count, null_pct, min, max, mean, median, std."""
    columns = [c for c in df.columns if c in roles.continuous]
    spark = df.sparkSession
    schema = ("column string, null_count long, null_pct double, min double, max double, "
              "mean double, median double, std double")
    if not columns:
        return spark.createDataFrame([], schema)
    medians = exact_quantiles(df, {c: [0.5] for c in columns})
    v = {c: as_number(c, df.schema[c].dataType) for c in columns}
    rows = F.count(F.lit(1))
    parts = [F.struct(
        F.lit(c).alias("column"),
        (rows - F.count(v[c])).alias("null_count"),
        F.round(F.coalesce(F.try_divide(rows - F.count(v[c]), rows), F.lit(0.0)), 4).alias("null_pct"),
        F.min(v[c]).alias("min"), F.max(v[c]).alias("max"),
        F.round(F.avg(v[c]), 4).alias("mean"),
        F.lit(medians[c][0]).cast("double").alias("median"),
        F.round(F.stddev(v[c]), 4).alias("std")) for c in columns]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def profile_categorical(df: DataFrame, roles: ColumnRoles, k: int = 5) -> DataFrame:
    """Per categorical column its ``k`` most frequent values (NULL is a value here)
    next to null_count, null_pct and n_unique."""
    columns = [c for c in df.columns if c in roles.categorical]
    schema = ("column string, null_count long, null_pct double, n_unique long, rank int, "
              "value string, value_count long")
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    counts = value_counts(df, columns)
    facts = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("null_count"),
        F.sum("count").alias("rows"), F.count("value").alias("n_unique"))
    return (top_values(counts, k).join(F.broadcast(facts), "column")  # one row per column
            .select("column", "null_count", F.round(F.col("null_count") / F.col("rows"), 4).alias("null_pct"),
                    "n_unique", "rank", "value", F.col("count").alias("value_count")))


def profile_summary(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Header of a profile: total_rows, total_columns and the role lists."""
    names = lambda cols: F.array(*[F.lit(c) for c in cols]).cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(len(df.columns)).alias("total_columns"),
        names(roles.categorical).alias("categorical_columns"),
        names(roles.continuous).alias("continuous_columns"))


def describe_all(df: DataFrame) -> DataFrame:
    """One row per column: count, unique, top, freq for texts and booleans; mean, std,
    min, quartiles, max for numbers (dates: count only)."""
    clean = nan_to_null(df)
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    labels = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    others = [f.name for f in df.schema.fields if f.name not in {*numbers, *labels}]
    null = lambda t: F.lit(None).cast(t)
    parts: list[DataFrame] = []
    if numbers:
        cuts = exact_quantiles(clean, {c: [0.25, 0.5, 0.75] for c in numbers})
        v = {c: as_number(c, df.schema[c].dataType) for c in numbers}
        structs = [F.struct(
            F.lit(c).alias("column"), F.count(v[c]).alias("count"), null("long").alias("unique"),
            null("string").alias("top"), null("long").alias("freq"), F.avg(v[c]).alias("mean"),
            F.stddev(v[c]).alias("std"), F.min(v[c]).alias("min"),
            *[F.lit(x).cast("double").alias(n) for x, n in zip(cuts[c], ("p25", "p50", "p75"))],
            F.max(v[c]).alias("max")) for c in numbers]
        parts.append(clean.agg(F.array(*structs).alias("a")).select(F.inline("a")))
    if labels:
        counts = value_counts(clean, labels).where("value IS NOT NULL")
        parts.append(counts.groupBy("column").agg(
            F.sum("count").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min(F.struct((-F.col("count")).alias("n"), "value")).alias("best")).select(
            "column", "count", "unique", F.col("best.value").alias("top"), (-F.col("best.n")).alias("freq"),
            *[null("double").alias(n) for n in ("mean", "std", "min", "p25", "p50", "p75", "max")]))
    if others:
        structs = [F.struct(F.lit(c).alias("column"), F.count(q(c)).alias("count"), null("long").alias("unique"),
                            null("string").alias("top"), null("long").alias("freq"),
                            *[null("double").alias(n) for n in ("mean", "std", "min", "p25", "p50", "p75", "max")])
                   for c in others]
        parts.append(clean.agg(F.array(*structs).alias("a")).select(F.inline("a")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preview_rows(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, in the order of ``order_by`` if given."""
    return (df.orderBy(*[q(c) for c in order_by]) if order_by else df).limit(int(n))


def preview_stats(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """Per column of the preview: dtype, null_count, unique_count; mean, min, max of numbers."""
    head = nan_to_null(preview_rows(df, n, order_by))
    structs = []
    for f in head.schema.fields:
        numeric = is_numeric(f.dataType)
        v = as_number(f.name, f.dataType) if numeric else q(f.name)
        nothing = F.lit(None).cast("double")
        structs.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            (F.count(F.lit(1)) - F.count(v)).alias("null_count"),
            F.size(F.collect_set(v)).cast("long").alias("unique_count"),  # of the `n` rows asked for
            (F.round(F.avg(v), 4) if numeric else nothing).alias("mean"),
            (F.min(v) if numeric else nothing).alias("min"), (F.max(v) if numeric else nothing).alias("max")))
    return head.agg(F.array(*structs).alias("a")).select(F.inline("a"))
