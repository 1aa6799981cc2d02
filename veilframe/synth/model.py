"""A fitted model: token intervals per column (given the parent's token), and sampling from it.

A column's tokens split [0, 1) into intervals. A row draws a uniform number and
takes the token whose interval holds it. Tables of checked size are searched as
arrays (``packed``). For larger ones the search is an equality join: [0, 1) is
cut into equal slots, intervals are listed under the slots they touch, and slots
are met uniformly, so no key is hot even when one token holds most of the mass.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.hashing import key_hash, uniform
from ..functions.ordered import dense_codes, running_totals
from ..operators.split import sample_rows
from ..session import materialize
from .conditional import candidates, column_predicates, conditioned, first_passing
from .packed import PackedColumn, draw_packed, pack
from .tokens import ColumnSpec, detokenize

NO_PARENT = ""
LEAST_SLOTS = 16
ROWS_PER_TASK = 2_000_000
SALTS = 32  # copies of a row of the slot sizes, for rows of a frequent parent token


def intervals(counts: DataFrame, ordered: bool = False) -> DataFrame:
    """``(target, parent_token, token, a, b)`` from ``(target, parent_token, token, n)``, ``n`` a whole number.

    Sums of whole numbers are exact, so an interval starts where the one before ends, and the last one ends at 1. Running
    sums are made in two levels (hash groups that grow with the root of the tokens), so a column with very many values is
    not summed in one task. ``ordered`` keeps the order of the tokens, for methods without parents: tokens are numbered
    over ranges, and summed range by range.
    """
    keys = ["target", "parent_token"]
    if ordered:
        place = F.struct(F.coalesce(F.col("token").try_cast("double"), F.lit(float("inf"))).alias("number"), F.col("token").alias("text"))
        codes = dense_codes(counts.select("target", place.alias("place")), "target", "place").select(
            F.col("target").alias("__c"), F.col("place.text").alias("__t"), "code")
        numbered = materialize(counts.join(codes, (F.col("target") == F.col("__c")) & (F.col("token") == F.col("__t"))).drop("__c", "__t"), "numbered")
        summed = running_totals(numbered, "code", {"__before": "n"}, "target")
        totals = numbered.groupBy("target").agg(F.sum("n").alias("__total"))
        return summed.join(totals, "target").select(
            *keys, "token", (F.col("__before") / F.col("__total")).alias("a"), ((F.col("__before") + F.col("n")) / F.col("__total")).alias("b"))
    groups = max(16, math.isqrt(counts.count()))
    cut = counts.withColumn("__g", F.pmod(F.xxhash64("token"), F.lit(groups)))
    sums = cut.groupBy(*keys, "__g").agg(F.sum("n").alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__g", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"),
                         F.sum("__s").over(Window.partitionBy(*keys)).alias("__total"))
    inside = Window.partitionBy(*keys, "__g").orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("__start") + F.sum("n").over(inside)
    return (cut.join(starts, [*keys, "__g"]).withColumn("__upto", upto)
            .select(*keys, "token", ((F.col("__upto") - F.col("n")) / F.col("__total")).alias("a"),
                    (F.col("__upto") / F.col("__total")).alias("b")))


def slot_counts(cells: DataFrame) -> dict[str, int]:
    """Slots per column: about one per token of its largest table."""
    sizes = cells.groupBy("target", "parent_token").agg(F.count(F.lit(1)).alias("n")).groupBy("target").agg(F.max("n").alias("n"))
    return {r["target"]: max(LEAST_SLOTS, 1 << math.ceil(math.log2(r["n"]))) for r in sizes.collect()}  # one row per column


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Standard normal distribution function (Abramowitz & Stegun 26.2.17, error below 7.5e-8)."""
    # The published coefficients.
    p, coefficients = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1.0 / (1.0 + p * np.abs(z))
    upper = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * sum(c * t ** (k + 1) for k, c in enumerate(coefficients))
    return np.minimum(np.where(z >= 0, 1.0 - upper, upper), 1.0 - 2.0 ** -53)


def correlated(raw: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Places in [0, 1) of correlated normals, one column for each row of ``factor``, from twice as many independent places."""
    d = len(factor)
    normal = np.sqrt(-2.0 * np.log(1.0 - raw[:, :d])) * np.cos(2.0 * np.pi * raw[:, d:])
    return normal_cdf(normal @ factor.T)


@dataclass
class Model:
    """Everything needed to sample; ``cells`` is a table, the rest is small."""

    kind: str
    specs: list[ColumnSpec]
    order: list[tuple[str, str | None]]      # (column, parent), parents first
    cells: DataFrame                         # target, parent_token, token, a, b
    slots: dict[str, int]
    sample_size: int
    seed: int | None = 42
    factor: list[list[float]] | None = None  # lower triangle of a correlation matrix
    dp_config: dict | None = None
    dp_spent: dict | None = None
    releases: list[dict] = field(default_factory=list)

    # -------------------------------------------------------------- sampling

    @cached_property
    def _packed(self) -> list[PackedColumn]:
        return pack(self.cells, self.order)

    def sample(self, n: int | None = None, seed: int | None = None, condition: str | None = None,
               max_tries: int = 100) -> DataFrame:
        """Exactly ``n`` rows (default: as many as were fitted), from the model alone.

        With ``condition`` (an SQL predicate) only rows that satisfy it are kept. What it asks of single columns of a tree
        is put into the tree (``conditional``), so such rows are drawn straight away, however rare they are; the rest
        is met by drawing in rounds. If ``max_tries`` rounds do not find enough, what was found is returned with a warning that
        names how many rows are missing and the share that satisfies what was put into the tree.
        """
        n = self.sample_size if n in (None, 0) else n
        if n <= 0:
            raise ValueError("the number of rows must be positive")
        seed = seed if seed is not None else (self.seed or 0)
        if condition is None:
            return self._draw(0, n, seed).drop("__id")
        source, predicates, given = self, {}, 1.0
        if self.factor is None:
            predicates = column_predicates(self.cells.sparkSession, self.specs, condition)
            source, given = conditioned(self, predicates)
        kept, have, start, size = [], 0, 0, n
        for _ in range(max_tries if given else 0):
            part = materialize(source._draw(start, start + size, seed, predicates).where(F.expr(condition)), "round")  # drawn once
            found = part.count()
            start += size
            # the next round is as large as the share kept so far suggests
            share = max((have + found) / start, 0.25 / start)
            if have + found > n:
                part, found = sample_rows(part, n - have, order=key_hash("__id"), rows=found), n - have
            if found:
                kept.append(part)
                have += found
            if have == n:
                break
            size = min(100 * n, math.ceil(1.2 * (n - have) / share) + 10)
        if have < n:
            warnings.warn(f"{n - have} of {n} rows are missing: {start} draws gave {have} that satisfy {condition!r}; a share of {given:.3g} of all "
                          "rows has what it asks of single columns", stacklevel=2)
        if not kept:
            return self._draw(0, 1, seed).drop("__id").limit(0)
        out = kept[0]
        for part in kept[1:]:
            out = out.unionByName(part)
        return out.drop("__id")

    def _draw(self, start: int, end: int, seed: int, predicates: dict[str, str] | None = None) -> DataFrame:
        spark = self.cells.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, math.ceil((end - start) / ROWS_PER_TASK))
        rows = spark.range(start, end, 1, tasks).withColumnRenamed("id", "__id")
        at = {c: i for i, (c, _) in enumerate(self.order)}
        packed = {p.place for p in self._packed}
        joined = [(i, c, p) for i, (c, p) in enumerate(self.order) if i not in packed]
        if self.factor is not None:
            factor, d = np.array(self.factor), len(self.order)
            # the numbers are hashes of the row id, so they do not depend on partitioning
            raw = {f"__{part}{j}": uniform(seed, part, j, F.col("__id")) for part in "ra" for j in range(d)}
            rows = draw_packed(rows.withColumns(raw), self._packed, list(raw), lambda x: correlated(x, factor), [i for i, _, _ in joined])
        elif packed:
            places = {f"__u{p.place}": uniform(seed, "t", self.order[p.place][0], F.col("__id")) for p in self._packed}
            rows = draw_packed(rows.withColumns(places), self._packed, list(places), None, [])
        for i, column, parent in joined:
            u = F.col(f"__u{i}") if self.factor is not None else uniform(seed, "t", column, F.col("__id"))
            cells = self.cells.where(F.col("target") == column)
            given = F.col(f"__t{at[parent]}") if parent else F.lit(NO_PARENT)
            drawn = rows.withColumns({"__u": u, "__given": given})
            k = F.lit(self.slots[column])
            if parent and self.slots[column] > LEAST_SLOTS:
                # every parent token has slots for its own table, so small tables stay small next to a large one
                slots = cells.groupBy(F.col("parent_token").alias("__q")).agg(
                    F.greatest(F.lit(LEAST_SLOTS), F.pow(F.lit(2), F.ceil(F.log2(F.count(F.lit(1)))))).cast("long").alias("__k"))
                cells = cells.join(slots, F.col("parent_token") == F.col("__q")).drop("__q")
                salted = slots.select("__q", F.col("__k").alias("__m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__w"))
                drawn = drawn.join(salted, (F.col("__given") == F.col("__q")) & (F.pmod(F.xxhash64("__id"), F.lit(SALTS)) == F.col("__w"))) \
                    .drop("__q", "__w")
                k = F.col("__k")
            table = cells.select(
                F.col("parent_token").alias("__p"), F.col("token").alias(f"__t{i}"), F.col("a").alias("__a"), F.col("b").alias("__b"),
                F.explode(F.sequence(F.floor(F.col("a") * k), F.greatest(F.floor(F.col("a") * k), F.ceil(F.col("b") * k) - 1))).alias("__s"))
            drawn = drawn.withColumn("__slot", F.floor(F.col("__u") * (F.col("__m") if "__m" in drawn.columns else k)))
            rows = (drawn.join(table, (F.col("__given") == F.col("__p")) & (F.col("__slot") == F.col("__s"))
                               & (F.col("__u") >= F.col("__a")) & (F.col("__u") < F.col("__b")))
                    .select(*[c for c in rows.columns if c != f"__u{i}"], f"__t{i}"))
        tried = [(i, s) for i, s in enumerate(self.specs) if s.continuous and s.name in (predicates or {})]
        if tried:
            rows = rows.withColumns({f"__v{i}": candidates(F.col(f"__t{at[s.name]}"), s, seed, "__id") for i, s in tried})
            place = {s.name: i for i, s in tried}
            return rows.select("__id", *[
                first_passing(f"__v{place[s.name]}", s.name, predicates[s.name]).alias(s.name) if s.name in place
                else detokenize(F.col(f"__t{at[s.name]}"), s, uniform(seed, "v", s.name, F.col("__id"))).alias(s.name) for s in self.specs])
        return rows.select("__id", *[
            detokenize(F.col(f"__t{at[s.name]}"), s, uniform(seed, "v", s.name, F.col("__id"))).alias(s.name) for s in self.specs])

    # --------------------------------------------------------------- reports

    def privacy_report(self) -> dict:
        """What was fitted, and the privacy budget asked for and spent (None without DP)."""
        return {"synthesizer": self.kind, "status": "fitted", "reproducibility": {"random_seed": self.seed},
                "data": {"sample_size": self.sample_size}, "dp_config": self.dp_config, "dp_spent": self.dp_spent}

    def report_frame(self) -> DataFrame:
        """The privacy report as one row with nested columns."""
        spark = self.cells.sparkSession
        return spark.createDataFrame([(json.dumps(self.privacy_report()),)], "json string").select(
            F.from_json("json", REPORT_SCHEMA).alias("r")).select("r.*")

    def ledger(self) -> DataFrame:
        """Every noisy release with its cost and the budget spent so far."""
        from .ledger import budget_ledger

        spark = self.cells.sparkSession
        rows = [("model", i + 1, r["release"], r["columns"], float(r["rho"]), float(r["epsilon"]), float(self.dp_config.get("delta_accounted", self.dp_config["delta"])))
                for i, r in enumerate(self.releases)]
        return budget_ledger(spark.createDataFrame(
            rows, "run_id string, step int, release string, columns string, rho double, epsilon double, delta double"))

    # --------------------------------------------------------------- storage

    def save(self, path: str, run_id: str | None = None, dataset_name: str | None = None, created_at: str | None = None) -> None:
        """Cells as Parquet, everything else in ``meta.json`` next to them."""
        spark = self.cells.sparkSession
        self.cells.write.mode("errorifexists").parquet(f"{path}/cells")
        meta = {"model_id": path.rstrip("/").split("/")[-1], "run_id": run_id, "dataset_name": dataset_name,
                "generator_type": self.kind, "created_at": created_at, "privacy_report": self.privacy_report(),
                "model": {"kind": self.kind, "specs": [s.as_dict() for s in self.specs], "order": self.order, "slots": self.slots,
                          "sample_size": self.sample_size, "seed": self.seed, "factor": self.factor, "dp_config": self.dp_config,
                          "dp_spent": self.dp_spent, "releases": self.releases}}
        _write_text(spark, f"{path}/meta.json", json.dumps({k: v for k, v in meta.items() if v is not None}))


REPORT_SCHEMA = ("synthesizer string, status string, reproducibility struct<random_seed: long>, data struct<sample_size: long>, "
                 "dp_config struct<is_dp_enabled: boolean, epsilon_initial: double, preprocessor_eps: double, sigma: double, delta: double, "
                 "domain_from_data: boolean>, dp_spent struct<spent_epsilon_final: double, epochs_requested: int, epochs_completed: int>")


def load_model(spark: SparkSession, path: str) -> Model:
    """A saved model; its kind is found in the stored description."""
    text = spark.read.option("wholetext", True).text(f"{path}/meta.json").first()["value"]
    m = json.loads(text)["model"]
    specs = [ColumnSpec(s["name"], s["type"], tuple(s["edges"])) for s in m["specs"]]
    return Model(m["kind"], specs, [(c, p) for c, p in m["order"]], spark.read.parquet(f"{path}/cells"), m["slots"], m["sample_size"],
                 m["seed"], m["factor"], m["dp_config"], m["dp_spent"], m["releases"])


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
