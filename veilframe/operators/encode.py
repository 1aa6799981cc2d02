"""Rows as vectors for distances: scaled numbers plus category codes.

One-hot columns are never built. Two rows differ in a category by the squared
distance 2 when both values are known, 1 when one of them is missing or unknown
to the fitted table, 0 when they are equal or both missing: exactly what one-hot
columns give, from one code per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.values import as_number, is_numeric, q
from ..session import materialize


@dataclass(frozen=True)
class Encoder:
    """Scaling ranges and category codes learnt from one table."""

    numeric: tuple[tuple[str, float, float], ...]   # name, minimum, range
    categorical: tuple[str, ...]
    codes: DataFrame | None                         # (slot int, value string, code long)

    @property
    def width(self) -> int:
        return len(self.numeric) + len(self.categorical)


def common_columns(reference: DataFrame, query: DataFrame) -> list[str]:
    """Columns both frames have, in reference order."""
    return [c for c in reference.columns if c in query.columns]


def _number(name: str, dtype: T.DataType) -> Column:
    value = q(name).cast("double") if isinstance(dtype, T.BooleanType) else as_number(name, dtype)
    return F.coalesce(value, F.lit(0.0))


def fit_encoder(table: DataFrame, columns: Sequence[str] | None = None) -> Encoder:
    """Learn the ranges of numbers and the dictionary of texts.

    A missing number counts as 0, a constant column has range 1, booleans are 0/1
    as they are. Dates and nested columns take no part in distances.
    """
    fields = [f for f in table.schema.fields if columns is None or f.name in columns]
    numbers = [f.name for f in fields if is_numeric(f.dataType)]
    flags = [f.name for f in fields if isinstance(f.dataType, T.BooleanType)]
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    scales: list[tuple[str, float, float]] = []
    if numbers:
        v = {c: _number(c, table.schema[c].dataType) for c in numbers}
        row = table.agg(*[F.min(v[c]).alias(f"lo{i}") for i, c in enumerate(numbers)],
                        *[F.max(v[c]).alias(f"hi{i}") for i, c in enumerate(numbers)]).first()
        for i, c in enumerate(numbers):
            low, high = row[f"lo{i}"] or 0.0, row[f"hi{i}"] or 0.0
            scales.append((c, low, (high - low) or 1.0))
    scales += [(c, 0.0, 1.0) for c in flags]
    codes = None
    if texts:
        slots = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), q(c).alias("value"))
                                    for i, c in enumerate(texts)])).alias("e")
        known = table.select(slots).select("e.*").where("value IS NOT NULL").distinct()
        # written out once, so the generated codes stay what they are
        codes = materialize(known.withColumn("code", F.monotonically_increasing_id()), "codes")
    return Encoder(tuple(scales), tuple(texts), codes)


def encode(df: DataFrame, encoder: Encoder, keep: Sequence[Column | str] = ()) -> DataFrame:
    """``keep`` columns plus ``num array<double>`` and ``cat array<long>`` (-1: missing or unknown).

    Scaled values are not clipped. Dictionary joins are left to the optimizer,
    which knows the dictionary's size from its files.
    """
    numbers = [((_number(c, df.schema[c].dataType) - F.lit(low)) / F.lit(span)) for c, low, span in encoder.numeric]
    extra = [F.col(c) if isinstance(c, str) else c for c in keep]
    work = df.select(F.struct(*extra).alias("__keep") if extra else F.lit(0).alias("__keep"),
                     F.array(*numbers).cast("array<double>").alias("num"),
                     *[q(c).cast("string").alias(f"__t{i}") for i, c in enumerate(encoder.categorical)])
    for i in range(len(encoder.categorical)):
        entries = encoder.codes.where(F.col("slot") == i).select(F.col("value").alias(f"__v{i}"),
                                                                 F.col("code").alias(f"__c{i}"))
        work = work.join(entries, F.col(f"__t{i}") == F.col(f"__v{i}"), "left")
    cats = F.array(*[F.coalesce(f"__c{i}", F.lit(-1)) for i in range(len(encoder.categorical))]).cast("array<long>")
    return work.select(*(["__keep.*"] if extra else []), "num", cats.alias("cat"))


def encoded_table(df: DataFrame, encoder: Encoder, keep: Sequence[str] = ()) -> DataFrame:
    """The vectors as plain columns: each scaled number, and each text or NULL if unknown."""
    out = [F.col(c) for c in keep]
    out += [((_number(c, df.schema[c].dataType) - F.lit(low)) / F.lit(span)).alias(c) for c, low, span in encoder.numeric]
    work = df
    for i, c in enumerate(encoder.categorical):
        entries = encoder.codes.where(F.col("slot") == i).select(F.col("value").alias(f"__v{i}"))
        work = work.join(entries, q(c) == F.col(f"__v{i}"), "left")
        out.append(F.col(f"__v{i}").alias(c))
    return work.select(*out)
