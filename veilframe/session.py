"""Session defaults and the shared folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "veilframe", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    command and adaptive execution decide both.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        defaults["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    defaults.update(conf)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session, where driver and executors are one process, may
    fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="veilframe-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_runs: list[str] = []  # folders of the runs that are open, the innermost last


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder of the open run, or else below the shared folder."""
    return f"{_runs[-1] if _runs else shared_dir(spark)}/veilframe-{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_run(spark: SparkSession, remove: bool = True) -> Iterator[str]:
    """Intermediate tables written inside share one folder, which is removed at the end.

    Results that are needed afterwards must be written elsewhere before; frames made inside cannot be read any more. With
    ``remove`` false the folder stays, and its path can be given to ``remove_path`` later.
    """
    root = scratch_path(spark, "run")
    _runs.append(root)
    try:
        yield root
    finally:
        _runs.remove(root)
        if remove:
            remove_path(spark, root)


def materialize(df: DataFrame, label: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Used where a frame is read several times or was costly to make. The files
    survive the loss of executors, and reading them back gives the optimizer
    true sizes for its join choices. Filters on ``partition_by`` skip whole folders.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c.replace('`', '``')}`" for c in df.columns])
