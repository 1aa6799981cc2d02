"""Column roles: which columns are categories, which are measured, which are left alone."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.values import as_number, is_numeric, q

MAX_UNIQUE_FOR_CATEGORICAL = 15
_SKETCH_SAFE_LIMIT = 100


@dataclass(frozen=True)
class ColumnRoles:
    """Every column of a table in exactly one of three lists, in table order."""

    categorical: tuple[str, ...] = ()
    continuous: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    order: tuple[str, ...] = field(default=(), repr=False)

    @property
    def classified(self) -> list[str]:
        known = {*self.categorical, *self.continuous}
        return [c for c in self.order if c in known]

    def role_of(self, column: str) -> str:
        if column in self.categorical:
            return "categorical"
        return "continuous" if column in self.continuous else "ignored"

    def restrict(self, df: DataFrame) -> DataFrame:
        """Keep only the categorical and continuous columns the frame has."""
        return df.select(*[q(c) for c in df.columns if c in {*self.categorical, *self.continuous}])

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per column: name, role."""
        rows = [(c, self.role_of(c)) for c in self.order]
        return spark.createDataFrame(rows, "column string, role string")


def detect_column_roles(df: DataFrame, exclude: Iterable[str] = (), force_categorical: Iterable[str] = (),
                        force_continuous: Iterable[str] = (),
                        max_unique: int = MAX_UNIQUE_FOR_CATEGORICAL) -> ColumnRoles:
    """Sort columns into roles.

    First matching rule wins: excluded → ignored; forced categorical; forced
    continuous; text or boolean → categorical; number with at most
    ``max_unique`` distinct values → categorical, otherwise continuous; the rest
    (dates, nested types) → ignored.
    """
    exclude, force_cat, force_cont = set(exclude), set(force_categorical), set(force_continuous)
    role: dict[str, str] = {}
    undecided = []
    for f in df.schema.fields:
        if f.name in exclude:
            role[f.name] = "ignored"
        elif f.name in force_cat:
            role[f.name] = "categorical"
        elif f.name in force_cont:
            role[f.name] = "continuous"
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            role[f.name] = "categorical"
        elif is_numeric(f.dataType):
            undecided.append(f.name)
        else:
            role[f.name] = "ignored"
    few = _at_most_distinct(df, undecided, max_unique)
    for c in undecided:
        role[c] = "categorical" if c in few else "continuous"
    pick = lambda wanted: tuple(c for c in df.columns if role[c] == wanted)
    return ColumnRoles(pick("categorical"), pick("continuous"), pick("ignored"), tuple(df.columns))


def _at_most_distinct(df: DataFrame, cols: list[str], limit: int) -> set[str]:
    """Columns with at most ``limit`` distinct non-null values, decided exactly.

    A sketch cannot show *fewer* values than its filled registers prove, so for
    small limits a sketch result clearly above the limit is proof of "more"; only
    the remaining, low-cardinality columns are counted exactly. Key-like columns
    are thus never shuffled.
    """
    if not cols:
        return set()
    values = {c: as_number(c, df.schema[c].dataType) if df.schema[c].dataType in (T.FloatType(), T.DoubleType())
              else q(c) for c in cols}
    unclear = cols
    if limit <= _SKETCH_SAFE_LIMIT:
        row = df.agg(*[F.approx_count_distinct(values[c]).alias(f"a{i}") for i, c in enumerate(cols)]).first()
        unclear = [c for i, c in enumerate(cols) if row[f"a{i}"] <= 2 * limit + 16]
    if not unclear:
        return set()
    row = df.agg(*[F.count_distinct(values[c]).alias(f"d{i}") for i, c in enumerate(unclear)]).first()
    return {c for i, c in enumerate(unclear) if row[f"d{i}"] <= limit}
