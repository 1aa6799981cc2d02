"""Small value-level expressions: missing values, bins, recoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

FRACTIONAL = (T.FloatType, T.DoubleType)
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)

# Texts a CSV reader takes for "missing" by default.
DEFAULT_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                     "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                     "n/a", "nan", "null")


def q(name: str) -> Column:
    """Column by literal name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def label_columns(df: DataFrame) -> list[str]:
    """Columns compared by value: texts and booleans (dates and nested types are left out)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of "missing": NaN becomes NULL in float columns."""
    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, FRACTIONAL)}
    if not fractional:
        return df
    return df.select(*[F.when(~F.isnan(q(c)), q(c)).alias(c) if c in fractional else q(c)
                       for c in df.columns])


def as_number(name: str, dtype: T.DataType) -> Column:
    """Column as DOUBLE with NaN read as NULL."""
    col = q(name).cast("double")
    return F.when(~F.isnan(col), col) if isinstance(dtype, FRACTIONAL) else col


def finite_or_null(col: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))), col)


def sanitize_nonfinite(df: DataFrame) -> DataFrame:
    """``finite_or_null`` on every float column and inside float arrays."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, FRACTIONAL):
            out.append(finite_or_null(q(field.name)).alias(field.name))
        elif (isinstance(field.dataType, T.ArrayType)
              and isinstance(field.dataType.elementType, FRACTIONAL)):
            out.append(F.transform(q(field.name), finite_or_null).alias(field.name))
        else:
            out.append(q(field.name))
    return df.select(*out)


def bin_column(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(edges[i], edges[i+1]]``; outside every bin → NULL."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    result = F.when((col > edges[0]) & (col <= edges[1]), labels[0])
    for low, high, label in zip(edges[1:-1], edges[2:], labels[1:]):
        result = result.when((col > low) & (col <= high), label)
    return result


def split_at(col: Column, threshold: float, low: str, high: str) -> Column:
    """``low`` up to and including the threshold, otherwise ``high`` (also for NULL)."""
    return F.when(col <= threshold, low).otherwise(high)


def recode_contains(col: Column, needle: str, hit: str, miss: str) -> Column:
    """``hit`` where the text holds ``needle``, otherwise ``miss`` (also for NULL)."""
    return F.when(col.cast("string").contains(needle), hit).otherwise(miss)


def recode_equals(col: Column, keep: str, other: str) -> Column:
    """``keep`` stays, everything else (also NULL) becomes ``other``."""
    return F.when(col == keep, col).otherwise(other)
