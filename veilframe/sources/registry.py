"""Append-only process registry: what ran, how it ended, and its JSON metadata.

Nothing is updated in place. Each change is a new row; the current state is the
latest value of each field (``process_state``).
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from .writers import publish

# Identifiers of the metadata types.
METADATA_TYPES = {
    "source_info": "11111111-1111-1111-1111-111111111111",
    "generator_config": "22222222-2222-2222-2222-222222222222",
    "privacy_report": "33333333-3333-3333-3333-333333333333",
    "utility_report": "44444444-4444-4444-4444-444444444444",
}

EVENTS = ("process_id string, at timestamp, status string, source_data_info string, config_rout string, "
          "synthetic_data_location string, report_location string, log_id string")
METADATA = "process_id string, metadata_type_id string, metadata_value string, created_at timestamp"
LOGS = "log_id string, log_content string, created_at timestamp"


def sanitize(value: Any) -> Any:
    """NaN and infinities become None, at any depth."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: sanitize(v) for k, v in value.items()}
    return [sanitize(v) for v in value] if isinstance(value, (list, tuple)) else value


class ProcessRegistry:
    """Registry tables below one folder of the shared storage.

    Inside ``with registry.batch():`` rows are held back and every table gets one file at the end; ``compact`` rewrites
    what single appends have left.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._held: dict[str, tuple[str, list[tuple]]] | None = None

    @contextmanager
    def batch(self) -> Iterator[ProcessRegistry]:
        """Rows of the body are written when it ends, also when it ends by an error; a batch inside another joins it."""
        if self._held is not None:
            yield self
            return
        self._held = {}
        try:
            yield self
        finally:
            held, self._held = self._held, None
            for table, (schema, rows) in held.items():
                self._write(table, schema, rows)

    def _append(self, table: str, schema: str, row: tuple) -> None:
        if self._held is not None:
            self._held.setdefault(table, (schema, []))[1].append(row)
        else:
            self._write(table, schema, [row])

    def _write(self, table: str, schema: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{table}")

    def compact(self, table: str, files: int = 1) -> None:
        """Put a table's rows into few files: a copy is written, the old files are set aside, and the copy takes their place."""
        fresh, old = f"{self.folder}/{table}-{uuid.uuid4().hex}", f"{self.folder}/{table}-old-{uuid.uuid4().hex}"
        self.table(table).coalesce(files).write.parquet(fresh)
        publish(self.spark, f"{self.folder}/{table}", old)
        publish(self.spark, fresh, f"{self.folder}/{table}")

    def start(self, process_id: str, source_info: str, config_path: str) -> None:
        self._append("process_events", EVENTS, (process_id, _now(), "RUNNING", source_info, config_path, None, None, None))

    def finish(self, process_id: str, status: str, synth_location: str | None = None,
               report_location: str | None = None) -> None:
        self._append("process_events", EVENTS, (process_id, _now(), status, None, None, synth_location, report_location, None))

    def add_metadata(self, process_id: str, kind: str, value: dict) -> None:
        text = json.dumps(sanitize(value), ensure_ascii=False)
        self._append("process_metadata", METADATA, (process_id, METADATA_TYPES.get(kind, kind), text, _now()))

    def add_log(self, process_id: str, content: str) -> None:
        log_id = str(uuid.uuid4())
        self._append("process_logs", LOGS, (log_id, content, _now()))
        self._append("process_events", EVENTS, (process_id, _now(), None, None, None, None, None, log_id))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def state(self) -> DataFrame:
        return process_state(self.table("process_events"), self.table("process_metadata"))


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def process_state(events: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Current state of every process: start and end time, the latest value of each field, and
    the latest JSON text of each metadata type. Two aggregates and one join on the process."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    ended = F.col("status").isNotNull() & (F.col("status") != "RUNNING")
    fields = ["status", "source_data_info", "config_rout", "synthetic_data_location", "report_location", "log_id"]
    state = events.groupBy("process_id").agg(
        F.min(F.when(F.col("status") == "RUNNING", F.col("at"))).alias("start_time"),
        F.max(F.when(ended, F.col("at"))).alias("end_time"), *[latest(c) for c in fields])
    if metadata is None:
        return state
    of_type = lambda i: F.col("metadata_type_id") == i
    values = metadata.groupBy("process_id").agg(*[
        F.max_by("metadata_value", F.when(of_type(i), F.col("created_at"))).alias(name)
        for name, i in METADATA_TYPES.items()])
    return state.join(values, "process_id", "left")
