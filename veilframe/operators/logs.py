"""Lines of many log files: the log of one run, and the budget printed while training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ordered import carry_forward, page_of

# How lines look.
TIME_PATTERN = r"^\[([^\]]*)\] "
EPOCH_PATTERN = r"Epoch (\d+),"
EPSILON_PATTERN = r"epsilon is ([0-9.]+(?:e[+-]?\d+)?)"
ALPHA_PATTERN = r"alpha is ([0-9.]+(?:e[+-]?\d+)?)"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, text)`` of text files; numbers grow along each file, with gaps. Files are told apart by their
    whole path."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"))


def run_log(lines: DataFrame, run_id: str, chunk_rows: int = 100_000) -> DataFrame:
    """``(ts, file, line_no, text)`` of one run: lines that name it, and the indented lines
    (tracebacks) that directly follow such a line in the same file.

    A line without a time of its own carries the time of the last line that has one.
    """
    text = F.col("text")
    stamp = F.regexp_extract(text, TIME_PATTERN, 1)
    named = text.contains(run_id)
    indented = text.rlike(r"^[ \t]")
    state = F.when(named, True).when(~indented, False)
    placed = carry_forward(lines, ["file"], "line_no", {
        "ts": F.when(stamp != "", stamp), "inside": state}, chunk_rows)
    return placed.where(F.coalesce("inside", F.lit(False))) \
        .select(F.coalesce("ts", F.lit("")).alias("ts"), "file", "line_no", "text")


def run_log_tail(lines: DataFrame, run_id: str, n: int) -> DataFrame:
    """The last ``n`` lines of ``run_log`` in (time, file, line) order."""
    if n < 1:
        raise ValueError("n must be positive")
    order = [F.col(c).desc() for c in ("ts", "file", "line_no")]
    return page_of(run_log(lines, run_id), order, 0, n)


def parse_budget_log(lines: DataFrame, chunk_rows: int = 100_000) -> DataFrame:
    """``(run_id, line_no, epoch, epsilon)``: every printed epsilon with the last epoch seen before
    it (0 if none). ``lines`` has ``(run_id, line_no, text)``."""
    number = lambda p, t: F.nullif(F.regexp_extract("text", p, 1), F.lit("")).cast(t)
    placed = carry_forward(lines, ["run_id"], "line_no", {"epoch": number(EPOCH_PATTERN, "int")}, chunk_rows)
    return placed.withColumn("epsilon", number(EPSILON_PATTERN, "double")).where("epsilon IS NOT NULL") \
        .select("run_id", "line_no", F.coalesce("epoch", F.lit(0)).alias("epoch"), "epsilon")


def budget_totals(lines: DataFrame) -> DataFrame:
    """Per run the last printed values: spent_epsilon, best_alpha, epochs_completed."""
    number = lambda p, t: F.nullif(F.regexp_extract("text", p, 1), F.lit("")).cast(t)
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    return lines.groupBy("run_id").agg(
        last(number(EPSILON_PATTERN, "double")).alias("spent_epsilon"), last(number(ALPHA_PATTERN, "double")).alias("best_alpha"),
        last(number(EPOCH_PATTERN, "int")).alias("epochs_completed"))
