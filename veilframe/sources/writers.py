"""Tables, records and reports to files and tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

_MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, one file per task, below ``path``."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_table(df: DataFrame, table: str, schema: str | None = None, if_exists: str = "replace",
                url: str | None = None, **options: str) -> None:
    """Save as a catalog table, or over JDBC when ``url`` is given."""
    if if_exists not in _MODES:
        raise ValueError(f"if_exists must be one of {sorted(_MODES)}, got {if_exists!r}")
    name = f"{schema}.{table}" if schema else table
    writer = df.write.mode(_MODES[if_exists])
    if url is None:
        writer.saveAsTable(name)
    else:
        writer.format("jdbc").option("url", url).option("dbtable", name).options(**options).save()


def as_records(df: DataFrame) -> DataFrame:
    """One JSON object per row, in column ``record``; missing fields are kept as null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def export_records(df: DataFrame, path: str, format: str = "csv") -> None:
    """Rows as CSV or as JSON lines."""
    if format == "csv":
        write_csv(df, path)
    elif format == "json":
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"format must be csv or json, got {format!r}")


def write_report(report: DataFrame, folder: str, dataset: str = "unknown", generator: str = "unknown",
                 at: datetime | None = None) -> str:
    """Save a one-row report as JSON under ``{dataset}__{generator}__{time}.json``."""
    stamp = (at or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    path = f"{folder.rstrip('/')}/{dataset}__{generator}__{stamp}.json"
    report.write.mode("errorifexists").json(path)
    return path


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """All saved reports with the name of the report they came from."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json/[^/]*$", 1)
    return spark.read.json(f"{folder.rstrip('/')}/*.json").select("*", name.alias("report_name"))


def publish(spark: SparkSession, staged: str, final: str) -> None:
    """Make a staged output final by renaming it; an existing final output is an error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(staged), hadoop.Path(final)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(final)
    parent = target.getParent()
    if parent is not None:
        fs.mkdirs(parent)
    if not fs.rename(source, target):
        raise OSError(f"could not rename {staged} to {final}")
