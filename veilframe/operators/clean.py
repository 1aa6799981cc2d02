"""Cleaning: missing tokens, duplicates, imputation, minimisation, type alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.quantiles import exact_medians
from ..functions.values import as_number, is_numeric, nan_to_null, q


def nullify(df: DataFrame, tokens: Iterable[str] = ("?",), columns: Iterable[str] | None = None) -> DataFrame:
    """Text equal to one of ``tokens`` becomes NULL in string columns."""
    tokens = list(tokens)
    chosen = set(columns if columns is not None else df.columns)
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and f.name in chosen and tokens:
            out.append(F.when(~q(f.name).isin(tokens), q(f.name)).alias(f.name))
        else:
            out.append(q(f.name))
    return df.select(*out)


def dropna_any(df: DataFrame) -> DataFrame:
    """Drop rows with any missing value."""
    return nan_to_null(df).na.drop("any")


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop columns by name; unknown names are ignored."""
    return df.drop(*[c for c in columns if c in df.columns])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each group of equal rows; NULLs are equal to each other."""
    return nan_to_null(df).dropDuplicates()


# ---------------------------------------------------------------- imputation

def exact_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column, the smallest of ties; None if all missing.

    Values are counted per (column, value) with map-side combining, and only the
    best candidate per column is kept, so no task holds a whole column's values.
    """
    if not columns:
        return {}
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    found: dict[str, object] = dict.fromkeys(columns)
    for same_type in by_type.values():
        long = df.select(*[q(c) for c in same_type]).unpivot([], [q(c) for c in same_type], "column", "value") \
            if len(same_type) > 1 else df.select(F.lit(same_type[0]).alias("column"), q(same_type[0]).alias("value"))
        best = (long.where("value IS NOT NULL").groupBy("column", "value").count()
                .groupBy("column").agg(F.min(F.struct((-F.col("count")).alias("n"), "value")).alias("m")))
        for r in best.collect():  # one row per column
            found[r["column"]] = r["m"]["value"]
    return found


@dataclass(frozen=True)
class FillValues:
    """Fill values learnt from one frame, to be applied to any other."""

    numeric: dict[str, float | None] = field(default_factory=dict)
    other: dict[str, object] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """Fill missing values; numeric columns that are filled become DOUBLE."""
        out = []
        for f in df.schema.fields:
            c = f.name
            if self.numeric.get(c) is not None:
                out.append(F.coalesce(as_number(c, f.dataType), F.lit(self.numeric[c])).alias(c))
            elif self.other.get(c) is not None:
                out.append(F.coalesce(q(c), F.lit(self.other[c]).cast(f.dataType)).alias(c))
            else:
                out.append(q(c))
        return df.select(*out)


def learn_fill_values(df: DataFrame, columns: Sequence[str] | None = None, strict: bool = True) -> FillValues:
    """Median of numeric columns, mode of all others, for columns with missing values.

    With ``strict`` a column without any value is an error; otherwise texts fall
    back to the empty text.
    """
    names = [f.name for f in df.schema.fields if (columns is None or f.name in columns)
             and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    typed = {c: as_number(c, df.schema[c].dataType) if is_numeric(df.schema[c].dataType) else q(c) for c in names}
    if not names:
        return FillValues()
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(typed[c]).alias(f"c{i}") for i, c in enumerate(names)]).first()
    holes = [c for i, c in enumerate(names) if row[f"c{i}"] < row["n"]]
    empty = [c for i, c in enumerate(names) if row["n"] and not row[f"c{i}"]]
    if empty and strict:
        raise ValueError(f"columns without any value cannot be imputed: {empty}")
    numeric = exact_medians(df, [c for c in holes if is_numeric(df.schema[c].dataType)])
    other = exact_modes(df, [c for c in holes if not is_numeric(df.schema[c].dataType)])
    if not strict:
        other = {c: "" if v is None and isinstance(df.schema[c].dataType, T.StringType) else v
                 for c, v in other.items()}
    return FillValues(numeric, other)


def impute(df: DataFrame) -> DataFrame:
    """Fill each column's missing values from its own median or mode."""
    clean = nan_to_null(df)
    return learn_fill_values(clean).apply(clean)


def preprocess(df: DataFrame) -> DataFrame:
    """Duplicates out first, then imputation; rows made equal by filling stay."""
    return impute(drop_duplicates(df))


def impute_from_train(train: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill both frames with values learnt from ``train`` only, for columns with
    holes in either frame."""
    train, other = nan_to_null(train), nan_to_null(other)
    shared = [c for c in train.columns if c in other.columns]
    counts = [d.agg(F.count(F.lit(1)).alias("n"), *[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(shared)]).first()
              for d in (train, other)]
    holes = [c for i, c in enumerate(shared) if any(r[f"c{i}"] < r["n"] for r in counts)]
    numeric = [c for c in holes if is_numeric(train.schema[c].dataType)]
    modes = exact_modes(train, [c for c in holes if c not in numeric])
    fill = FillValues(exact_medians(train, numeric),
                      {c: "" if v is None and isinstance(train.schema[c].dataType, T.StringType) else v
                       for c, v in modes.items()})
    return fill.apply(train), fill.apply(other)


# -------------------------------------------------------------- minimisation

SKETCH_ERROR = 0.01     # standard error of a sketched number of distinct values
SKETCH_ERRORS = 8       # a sketch is trusted beyond so many of them


@dataclass(frozen=True)
class MinimizationReport:
    removed_direct_identifiers: list[str]
    removed_high_cardinality: list[str]
    columns_before: int
    columns_after: int
    rows_unchanged: bool = True  # only columns are ever dropped

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.removed_direct_identifiers, self.removed_high_cardinality,
              self.columns_before, self.columns_after, self.rows_unchanged)],
            "removed_direct_identifiers array<string>, removed_high_cardinality array<string>, "
            "columns_before int, columns_after int, rows_unchanged boolean")


def minimize(df: DataFrame, direct_identifiers: Iterable[str] = (), drop_high_cardinality: bool = False,
             cardinality_threshold: float = 0.9) -> tuple[DataFrame, MinimizationReport]:
    """Drop direct identifiers, then text columns whose share of distinct values is
    above the threshold. Numbers and booleans are never dropped by cardinality."""
    removed = [c for c in dict.fromkeys(direct_identifiers) if c in df.columns]
    kept = df.drop(*removed)
    crowded: list[str] = []
    if drop_high_cardinality:
        crowded = high_cardinality_columns(kept, cardinality_threshold)
        kept = kept.drop(*crowded)
    return kept, MinimizationReport(removed, crowded, len(df.columns), len(kept.columns))


def high_cardinality_columns(df: DataFrame, threshold: float = 0.9) -> list[str]:
    """Text columns with ``distinct / rows`` strictly above the threshold.

    One pass with a sketch per column decides those that are further from the threshold than ``SKETCH_ERRORS`` standard errors;
    the others are counted exactly, one column at a time, so no row is copied for each column.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return []
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.approx_count_distinct(q(c), SKETCH_ERROR).alias(f"d{i}") for i, c in enumerate(texts)]).first()
    wanted = []
    for i, c in enumerate(texts):
        found, limit = row[f"d{i}"], threshold * row["n"]
        if abs(found - limit) <= SKETCH_ERRORS * SKETCH_ERROR * max(found, limit):
            found = df.select(F.count_distinct(q(c))).first()[0]
        if row["n"] and found / row["n"] > threshold:
            wanted.append(c)
    return wanted


# ------------------------------------------------------- types, generalising

def align_types(synth: DataFrame, real: DataFrame) -> DataFrame:
    """Cast each shared column to the real column's type; a column with a value that
    cannot be cast stays as it is."""
    wanted = {f.name: f.dataType for f in real.schema.fields}
    changing = [f.name for f in synth.schema.fields if f.name in wanted and f.dataType != wanted[f.name]]
    if not changing:
        return synth
    row = synth.agg(*[F.count(F.when(q(c).isNotNull() & q(c).try_cast(wanted[c]).isNull(), 1)).alias(f"b{i}")
                      for i, c in enumerate(changing)]).first()
    good = {c for i, c in enumerate(changing) if row[f"b{i}"] == 0}
    return synth.select(*[q(c).try_cast(wanted[c]).alias(c) if c in good else q(c) for c in synth.columns])


def generalize(df: DataFrame, rules: Mapping[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """Add coarser versions of columns: ``rules`` maps a column to the new column's name and the expression that makes it.

    Rules for columns that ``df`` does not have are passed over; a new column takes the place of one of its name.
    ``functions.values`` has the usual expressions (bins, thresholds, recoding).
    """
    return df.withColumns({name: make(q(column)) for column, (name, make) in rules.items() if column in df.columns})
