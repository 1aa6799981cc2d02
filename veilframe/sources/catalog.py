"""Listings of dataset files and saved models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.ordered import paged

_SEPARATOR_OUTSIDE_QUOTES = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
HIDDEN_MARK = "_synth_"


def dataset_summary(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Per CSV file: name, rows, columns, file_size_bytes, uploaded_at; newest first.

    Rows are counted by the CSV reader. Files with ``_synth_`` in their name are hidden.
    """
    meta = [F.col(f"_metadata.{n}").alias(n) for n in ("file_path", "file_name", "file_size", "file_modification_time")]
    lines = spark.read.text(path).select(*meta, F.col("_metadata.file_block_start").alias("start"), "value",
                                         F.monotonically_increasing_id().alias("nth"))
    files = lines.groupBy("file_path", "file_name", "file_size", "file_modification_time").agg(
        F.min_by("value", F.struct("start", "nth")).alias("header"))
    rows = (spark.read.schema("first string").option("header", True).option("multiLine", multi_line).csv(path)
            .select(F.col("_metadata.file_path").alias("file_path")).groupBy("file_path")
            .agg(F.count(F.lit(1)).alias("rows")))
    name = F.regexp_replace(F.url_decode("file_name"), r"\.[^.]*$", "")
    return (files.where(~F.col("file_name").contains(HIDDEN_MARK)).join(rows, "file_path", "left")
            .select(name.alias("name"), F.col("file_modification_time").alias("uploaded_at"),
                    F.coalesce("rows", F.lit(0)).alias("rows"),
                    F.size(F.split("header", _SEPARATOR_OUTSIDE_QUOTES)).alias("columns"),
                    F.col("file_size").alias("file_size_bytes"))
            .orderBy(F.col("uploaded_at").desc(), "name"))


def dataset_page(spark: SparkSession, path: str, page: int = 1, per_page: int = 20, multi_line: bool = False) -> DataFrame:
    """One page of ``dataset_summary``, with ``page, per_page, total, pages`` on every row."""
    return paged(dataset_summary(spark, path, multi_line), [F.col("uploaded_at").desc(), F.col("name").asc()], page, per_page)


SIDECAR = (
    "model_id string, run_id string, dataset_name string, generator_type string, created_at string, "
    "file_size_bytes long, privacy_report struct<synthesizer: string, data: struct<sample_size: long>, "
    "dp_config: struct<is_dp_enabled: boolean, epsilon_initial: double, preprocessor_eps: double, sigma: double, "
    "delta: double>, dp_spent: struct<spent_epsilon_final: double, epochs_requested: int, epochs_completed: int>>, "
    "_corrupt_record string")


def model_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """One row per saved model, newest first. A missing or broken sidecar leaves the fields empty,
    with dataset "unknown" and the newest file time as creation time."""
    root = folder.rstrip("/")
    model_of = lambda depth: F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)(?:/[^/]+){{{depth}}}$", 1)
    parts = (spark.read.format("binaryFile").load(f"{root}/*/cells/*.parquet")
             .select(model_of(2).alias("model_id"), "length", "modificationTime")
             .groupBy("model_id").agg(F.sum("length").alias("size"), F.max("modificationTime").alias("modified")))
    schema = T.StructType.fromDDL(SIDECAR)
    fields = [f for f in schema.fields if f.name != "model_id"]
    try:
        sidecars = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE") \
            .json(f"{root}/*/meta.json").select(model_of(1).alias("id"), *[F.col(f.name) for f in fields])
    except Exception as missing:  # no sidecar at all
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        sidecars = spark.createDataFrame([], T.StructType([T.StructField("id", T.StringType()), *fields]))
    joined = parts.join(sidecars, F.col("model_id") == F.col("id"), "left")
    report = F.col("privacy_report")
    return joined.select(
        "model_id", "run_id", F.coalesce("dataset_name", F.lit("unknown")).alias("dataset_name"),
        F.coalesce(F.to_timestamp(F.try_to_timestamp("created_at")), "modified").alias("created_at"),
        F.coalesce("file_size_bytes", "size").alias("file_size_bytes"),
        report.dp_config.epsilon_initial.alias("epsilon"), report.dp_spent.epochs_completed.alias("epochs_completed"),
        report.dp_spent.spent_epsilon_final.alias("spent_epsilon"), report.data.sample_size.alias("sample_size"),
    ).orderBy(F.col("created_at").desc(), "model_id")


def model_page(spark: SparkSession, folder: str, page: int = 1, per_page: int = 20) -> DataFrame:
    """One page of ``model_catalog``, with ``page, per_page, total, pages`` on every row."""
    return paged(model_catalog(spark, folder), [F.col("created_at").desc(), F.col("model_id").asc()], page, per_page)
