"""Run history: merging, filtering, paging, parsing archived rows, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import paged
from ..functions.values import q

RUN_FIELDS = ["run_id", "status", "verdict", "dataset_name", "config_name", "created_at", "started_at", "finished_at"]


def duration_sec(start: Column, end: Column) -> Column:
    """Seconds between two times, NULL if one is missing."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def path_stem(path: Column) -> Column:
    """File name without folders and last extension; "unknown" when missing or empty."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?/*$", 1)
    return F.when(path.isNull() | (path == ""), "unknown").otherwise(stem)


def parse_process_status(processes: DataFrame) -> DataFrame:
    """Archived process rows as runs: ``COMPLETED_x`` → completed with verdict x, ``RUNNING`` →
    running, anything else (also missing) → failed."""
    status = F.col("status")
    done = F.coalesce(status.startswith("COMPLETED_"), F.lit(False))
    return processes.select(
        F.col("process_id").cast("string").alias("run_id"),
        F.when(done, "completed").when(status == "RUNNING", "running").otherwise("failed").alias("status"),
        F.when(done, F.substring(status, len("COMPLETED_") + 1, 1 << 20)).alias("verdict"),
        path_stem(F.col("source_data_info")).alias("dataset_name"), path_stem(F.col("config_rout")).alias("config_name"),
        F.col("start_time").alias("created_at"), F.col("start_time").alias("started_at"), F.col("end_time").alias("finished_at"),
        duration_sec(F.col("start_time"), F.col("end_time")).alias("duration_sec"))


def run_history(active: DataFrame, archived: DataFrame) -> DataFrame:
    """One row per run: the active row where there is one, otherwise the archived row.

    An aggregate with map-side combining keeps the preferred row of each run.
    """
    columns = archived.columns
    both = (active.select(*[q(c) for c in columns], F.lit(0).alias("__rank"))
            .unionByName(archived.select(*[q(c) for c in columns], F.lit(1).alias("__rank"))))
    kept = both.groupBy("run_id").agg(F.min_by(F.struct(*[q(c) for c in columns]), "__rank").alias("r"))
    return kept.select("r.*")


def filter_runs(runs: DataFrame, status: str | None = None, verdict: str | None = None,
                dataset_name: str | None = None) -> DataFrame:
    for column, wanted in (("status", status), ("verdict", verdict), ("dataset_name", dataset_name)):
        if wanted:
            runs = runs.where(F.col(column) == wanted)
    return runs


def run_page(runs: DataFrame, page: int = 1, per_page: int = 20, **filters: str | None) -> DataFrame:
    """One page of the filtered runs, newest first (ties by run_id), with ``page, per_page,
    total, pages`` on every row."""
    return paged(filter_runs(runs, **filters), [F.col("created_at").desc(), F.col("run_id").asc()], page, per_page)


def run_metrics(runs: DataFrame) -> DataFrame:
    """Counters in long form ``(metric, status, verdict, value)``: runs by status and verdict,
    queued and running runs, mean duration. One aggregate over the runs, one over its groups."""
    seconds = duration_sec(F.col("started_at"), F.col("finished_at"))
    groups = runs.groupBy("status", F.coalesce("verdict", F.lit("")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("seconds"), F.count(seconds).alias("timed"))
    none = F.lit(None).cast("string")
    counts = groups.select(F.lit("runs_total").alias("metric"), "status", "verdict", F.col("n").cast("double").alias("value"))
    state = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).cast("double")
    gauges = groups.agg(F.array(
        F.struct(F.lit("queue_size").alias("metric"), F.lit("queued").alias("status"), state("queued").alias("value")),
        F.struct(F.lit("queue_size").alias("metric"), F.lit("running").alias("status"), state("running").alias("value")),
        F.struct(F.lit("run_duration_seconds_avg").alias("metric"), none.alias("status"),
                 F.round(F.try_divide(F.sum("seconds"), F.sum("timed")), 2).alias("value"))).alias("g")) \
        .select(F.inline("g")).where("value IS NOT NULL").select("metric", "status", none.alias("verdict"), "value")
    return counts.unionByName(gauges)
