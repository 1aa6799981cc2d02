"""Column-by-column comparison of a real and a synthetic table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.values import as_number, label_columns, nan_to_null, numeric_columns, q
from .profile import _long

JSD_BINS = 50
SMOOTHING = 1e-10


def shared_columns(real: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """Numeric and label columns of ``real`` that ``synth`` has too."""
    keep = lambda names: [c for c in names if c in synth.columns and (columns is None or c in columns)]
    return keep(numeric_columns(real)), keep(label_columns(real))


def _sides(real: DataFrame, synth: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """``(is_real, column, value)`` of both tables."""
    return (_long(real, columns, kind).withColumn("is_real", F.lit(1))
            .unionByName(_long(synth, columns, kind).withColumn("is_real", F.lit(0))))


def jsd_numeric(real: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None,
                bins: int = JSD_BINS, facts: dict[str, dict] | None = None) -> DataFrame:
    """``(column, jsd)``: Jensen-Shannon divergence of histograms over the joint range.

    Natural logarithm, so the range is 0 … ln 2. A little mass is added to every
    density as smoothing. Columns with one single value give 0; without values on
    a side, NULL.
    """
    cols, _ = shared_columns(real, synth, columns)
    if not cols:
        return real.sparkSession.createDataFrame([], "column string, jsd double")
    facts = facts if facts is not None else side_facts(real, synth, cols)[0]
    rows = []
    for i, c in enumerate(cols):
        r, s = facts[f"r{i}"], facts[f"s{i}"]
        rows.append((c, min((f["min"] for f in (r, s) if f["n"]), default=None), max((f["max"] for f in (r, s) if f["n"]), default=None),
                     r["n"], s["n"]))
    spans = real.sparkSession.createDataFrame(rows, "column string, lo double, hi double, nr long, ns long")
    width = (F.col("hi") - F.col("lo")) / bins
    wide = [(c, lo, (hi - lo) / bins) for c, lo, hi, *_ in rows if lo is not None and hi > lo]

    def places(d: DataFrame, is_real: int) -> DataFrame:
        """Bin numbers of all columns, computed before the columns are unfolded."""
        cut = []
        for c, lo, w in wide:
            x = as_number(c, d.schema[c].dataType)
            cut.append(F.when(x.isNotNull(), F.least(F.floor((x - lo) / w), F.lit(bins - 1))).alias(c))
        cut = d.select(*cut)
        long = cut.select(F.lit(wide[0][0]).alias("column"), q(wide[0][0]).alias("bin")) if len(wide) == 1 \
            else cut.unpivot([], [q(c) for c, *_ in wide], "column", "bin")
        return long.withColumn("is_real", F.lit(is_real))

    share = lambda n, total: ((F.col(n) / F.col(total) + SMOOTHING * width) / (1 + bins * SMOOTHING * width))
    if not wide:
        return spans.select("column", F.when((F.col("nr") > 0) & (F.col("ns") > 0), F.lit(0.0)).alias("jsd"))
    counts = (places(real, 1).unionByName(places(synth, 0)).where("bin IS NOT NULL")
              .groupBy("column", "bin").agg(F.sum("is_real").alias("r"), F.sum(1 - F.col("is_real")).alias("s")))
    # bins that are empty on both sides have equal shares and add nothing
    part = counts.join(F.broadcast(spans), "column").select(  # one row per column
        "column", share("r", "nr").alias("p"), share("s", "ns").alias("q"))
    middle = (F.col("p") + F.col("q")) / 2
    term = (F.col("p") * F.log(F.col("p") / middle) + F.col("q") * F.log(F.col("q") / middle)) / 2
    sums = part.groupBy("column").agg(F.sum(term).alias("d"))
    return spans.join(sums, "column", "left").select(
        "column", F.when((F.col("nr") > 0) & (F.col("ns") > 0), F.coalesce("d", F.lit(0.0))).alias("jsd"))


def side_facts(real: DataFrame, synth: DataFrame, cols: Sequence[str], median: bool = False) -> tuple[dict, dict]:
    """Facts (n, min, max, mean, std) and medians of numeric columns, both tables in the same
    passes: column i of the real table is ``r{i}``, of the synthetic table ``s{i}``."""
    def part(d: DataFrame, mine: str, other: str) -> DataFrame:
        return d.select(*[as_number(c, d.schema[c].dataType).alias(f"{mine}{i}") for i, c in enumerate(cols)],
                        *[F.lit(None).cast("double").alias(f"{other}{i}") for i in range(len(cols))])

    facts: dict[str, dict] = {}
    both = part(real, "r", "s").unionByName(part(synth, "s", "r"))
    found = exact_quantiles(both, {f"{side}{i}": [0.5] if median else [] for i in range(len(cols)) for side in "rs"}, facts=facts)
    return facts, {c: v[0] for c, v in found.items()} if median else {}


def stat_deltas(real: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None, known: tuple[dict, dict] | None = None) -> DataFrame:
    """``(column, mean_delta, std_delta, median_delta)``, real minus synthetic, 4 digits."""
    schema = "column string, mean_delta double, std_delta double, median_delta double"
    cols, _ = shared_columns(real, synth, columns)
    if not cols:
        return real.sparkSession.createDataFrame([], schema)
    facts, medians = known or side_facts(real, synth, cols, median=True)
    gap = lambda a, b: None if a is None or b is None else float(a) - float(b)
    data = [(c, gap(facts[f"r{i}"]["mean"], facts[f"s{i}"]["mean"]), gap(facts[f"r{i}"]["std"], facts[f"s{i}"]["std"]),
             gap(medians[f"r{i}"], medians[f"s{i}"])) for i, c in enumerate(cols)]
    frame = real.sparkSession.createDataFrame(data, schema)
    return frame.select("column", *[F.round(c, 4).alias(c) for c in frame.columns[1:]])


def tvd_categorical(real: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, tvd)``: total-variation distance of the non-null values; all columns and
    both tables in one aggregate."""
    _, cols = shared_columns(real, synth, columns)
    if not cols:
        return real.sparkSession.createDataFrame([], "column string, tvd double")
    counts = (_sides(nan_to_null(real), nan_to_null(synth), cols, "string").where("value IS NOT NULL")
              .groupBy("column", "value").agg(F.sum("is_real").alias("r"), F.sum(1 - F.col("is_real")).alias("s")))
    totals = counts.groupBy("column").agg(F.sum("r").alias("nr"), F.sum("s").alias("ns"))
    gap = F.abs(F.coalesce(F.try_divide("r", "nr"), F.lit(0.0)) - F.coalesce(F.try_divide("s", "ns"), F.lit(0.0)))
    return (counts.join(F.broadcast(totals), "column")  # one row per column
            .groupBy("column").agg((F.sum(gap) / 2).alias("tvd")))


def marginal_report(real: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long form ``(kind, column, metric, value)`` of all column comparisons."""
    long = lambda d, kind, names: d.unpivot("column", names, "metric", "value") \
        .select(F.lit(kind).alias("kind"), "column", "metric", "value")
    cols, _ = shared_columns(real, synth, columns)
    known = side_facts(real, synth, cols, median=True) if cols else ({}, {})
    jsd = jsd_numeric(real, synth, columns, facts=known[0]).withColumn("jsd", F.round("jsd", 6))
    tvd = tvd_categorical(real, synth, columns).withColumn("tvd", F.round("tvd", 6))
    deltas = stat_deltas(real, synth, columns, known)
    return (long(jsd, "numerical", ["jsd"]).unionByName(long(deltas, "numerical", ["mean_delta", "std_delta", "median_delta"]))
            .unionByName(long(tvd, "categorical", ["tvd"])))


def summary_of(report: DataFrame) -> DataFrame:
    """One row: mean_jsd and mean_tvd of a ``marginal_report`` (NULL without such columns)."""
    mean = lambda m: F.round(F.avg(F.when(F.col("metric") == m, F.col("value"))), 6).alias(f"mean_{m}")
    return report.agg(mean("jsd"), mean("tvd"))


def marginal_summary(real: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: mean_jsd and mean_tvd over the rounded column values (NULL without columns)."""
    both = (jsd_numeric(real, synth, columns).select(F.lit("jsd").alias("metric"), F.round("jsd", 6).alias("value"))
            .unionByName(tvd_categorical(real, synth, columns).select(F.lit("tvd").alias("metric"), F.round("tvd", 6).alias("value"))))
    return summary_of(both)
