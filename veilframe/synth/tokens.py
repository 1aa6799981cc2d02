"""Columns as tokens: texts as they are, numbers as the number of their bin."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.values import as_number, is_numeric, q
from ..operators.roles import ColumnRoles

NULL_TOKEN = "\u0001missing"
BINS = 32


@dataclass(frozen=True)
class ColumnSpec:
    """How one column is turned into tokens and back."""

    name: str
    type: str                       # Spark type as text
    edges: tuple[float, ...] = ()   # bin edges of a continuous column

    @property
    def continuous(self) -> bool:
        return bool(self.edges)

    @property
    def tokens(self) -> list[str]:
        """All bins of a continuous column, and the token of a missing value."""
        return [*(str(i) for i in range(len(self.edges) - 1)), NULL_TOKEN]

    def as_dict(self) -> dict:
        return asdict(self)


def column_specs(df: DataFrame, roles: ColumnRoles, bins: int = BINS,
                 edges: dict[str, Sequence[float]] | None = None) -> list[ColumnSpec]:
    """Specs of the classified columns; bins of continuous columns hold about equally many
    rows (from a sketch) unless their edges are given."""
    given = dict(edges or {})
    names = [c for c in df.columns if c in {*roles.categorical, *roles.continuous}]
    open_columns = [c for c in names if c in roles.continuous and c not in given]
    if open_columns:
        points = [i / bins for i in range(bins + 1)]
        row = df.agg(*[F.percentile_approx(as_number(c, df.schema[c].dataType), points, 10_000).alias(f"p{i}")
                       for i, c in enumerate(open_columns)],
                     *[e for i, c in enumerate(open_columns) for e in (
                         F.min(as_number(c, df.schema[c].dataType)).alias(f"lo{i}"),
                         F.max(as_number(c, df.schema[c].dataType)).alias(f"hi{i}"))]).first()
        for i, c in enumerate(open_columns):
            inner = sorted({float(e) for e in row[f"p{i}"] or []} | {float(row[e]) for e in (f"lo{i}", f"hi{i}") if row[e] is not None})
            inner = inner or [0.0]
            given[c] = inner if len(inner) > 1 else [inner[0], inner[0] + 1.0]
    return [ColumnSpec(c, df.schema[c].dataType.simpleString(), tuple(float(e) for e in given[c]) if c in roles.continuous else ())
            for c in names]


def tokenize(df: DataFrame, specs: Sequence[ColumnSpec]) -> DataFrame:
    """Every column replaced by its token. Values outside the edges go to the end bins."""
    work = df.select(*[q(s.name) for s in specs])
    numbers = [s for s in specs if s.continuous]
    if numbers:
        clipped = [F.greatest(F.lit(s.edges[0]), F.least(F.lit(s.edges[-1]), as_number(s.name, df.schema[s.name].dataType)))
                   for s in numbers]
        present = [as_number(s.name, df.schema[s.name].dataType).isNotNull() for s in numbers]
        work = work.select("*", *[F.when(p, v).alias(f"__n{i}") for i, (p, v) in enumerate(zip(present, clipped))])
        work = Bucketizer(splitsArray=[list(s.edges) for s in numbers], inputCols=[f"__n{i}" for i in range(len(numbers))],
                          outputCols=[f"__b{i}" for i in range(len(numbers))], handleInvalid="keep").transform(work)
    at = {s.name: i for i, s in enumerate(numbers)}

    def token(s: ColumnSpec) -> Column:
        if not s.continuous:
            return F.coalesce(q(s.name).cast("string"), F.lit(NULL_TOKEN)).alias(s.name)
        i = at[s.name]
        return F.when(F.col(f"__n{i}").isNull(), NULL_TOKEN).otherwise(F.col(f"__b{i}").cast("int").cast("string")).alias(s.name)

    return work.select(*[token(s) for s in specs])


def detokenize(token: Column, spec: ColumnSpec, u: Column) -> Column:
    """Token back to a value; ``u`` places a number inside its bin."""
    kind = T._parse_datatype_string(spec.type)
    present = F.when(token != NULL_TOKEN, token)
    if not spec.continuous:
        return present.cast(kind)
    edges = F.array(*[F.lit(e) for e in spec.edges])
    low = F.element_at(edges, present.cast("int") + 1)
    high = F.element_at(edges, present.cast("int") + 2)
    value = low + (high - low) * u
    whole = is_numeric(kind) and not isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))
    # whole numbers: spread over [low, high), and the last edge itself stays reachable
    last = F.lit(spec.edges[-1])
    return F.least(F.floor(low + (high - low + F.when(high == last, 1).otherwise(0)) * u), last).cast(kind) if whole \
        else value.cast(kind)
