"""Tables from CSV files, SQL and JDBC."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.values import DEFAULT_NA_TOKENS, q


def read_csv(spark: SparkSession, path: str, na_values: Iterable[str] = ("?",), skip_initial_space: bool = True,
             schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header. ``na_values`` are added to the usual missing tokens.

    Without ``schema`` one aggregate over the file decides whole-number, number,
    boolean or text for every column; give a schema to save that pass.
    ``multi_line`` allows line breaks inside quotes but reads each file in one task.
    """
    raw = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
           .option("ignoreLeadingWhiteSpace", skip_initial_space).option("multiLine", multi_line).csv(path))
    tokens = list(dict.fromkeys([*DEFAULT_NA_TOKENS, *na_values]))
    text = raw.select(*[F.when(~q(c).isin(tokens), q(c)).alias(c) for c in raw.columns])
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        types = {f.name: f.dataType for f in wanted.fields}
    else:
        types = _infer(text)
    return text.select(*[q(c).cast(types[c]).alias(c) if c in types else q(c) for c in text.columns])


def _infer(text: DataFrame) -> dict[str, T.DataType]:
    """Narrowest type every present value of a column can be read as."""
    candidates = (T.LongType(), T.DoubleType(), T.BooleanType())

    def fits(c: str, kind: T.DataType):
        if isinstance(kind, T.BooleanType):
            return F.lower(q(c)).isin("true", "false")
        if isinstance(kind, T.LongType):
            return q(c).rlike(r"^\s*[+-]?\d+\s*$") & q(c).try_cast(kind).isNotNull()
        return q(c).try_cast(kind).isNotNull() & ~q(c).rlike(r"[dDfF]\s*$")

    row = text.agg(*[e for i, c in enumerate(text.columns) for e in (
        F.count(q(c)).alias(f"n{i}"), *[F.count(F.when(fits(c, k), 1)).alias(f"n{i}_{j}") for j, k in enumerate(candidates)])]).first()
    out: dict[str, T.DataType] = {}
    for i, c in enumerate(text.columns):
        out[c] = T.StringType()
        for j, k in enumerate(candidates):
            if row[f"n{i}"] and row[f"n{i}"] == row[f"n{i}_{j}"]:
                out[c] = k
                break
    return out


def read_sql(spark: SparkSession, query: str, url: str | None = None, partition: dict[str, str] | None = None,
             **options: str) -> DataFrame:
    """Result of a SELECT: over this session's views, or over JDBC when ``url`` is given.

    ``partition`` (column, lower, upper, parts) reads over JDBC with many tasks. An
    empty result is an error.
    """
    if url is None:
        df = spark.sql(query)
    else:
        reader = spark.read.format("jdbc").option("url", url).options(**options)
        if partition:
            reader = (reader.option("dbtable", f"({query}) AS t").option("partitionColumn", partition["column"])
                      .option("lowerBound", partition["lower"]).option("upperBound", partition["upper"])
                      .option("numPartitions", partition["parts"]))
        else:
            reader = reader.option("query", query)
        df = reader.load()
    if df.isEmpty():
        raise ValueError("the query returned no rows")
    return df
