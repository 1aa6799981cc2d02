"""Differentially private dependency tree.

Counting runs on Spark over the raw table. What leaves the raw data is only: one histogram per column, the choice of links,
and one pair table per link, each with noise, each written to the ledger. Noise is added where the counts are, by a function
of the cell's name and a key (``noise``), so a task that is run again can not draw new noise; the driver sees one number per
column or pair of columns.

A column of a declared domain (bins, or ``domains``) gets noise in every cell, also the empty ones. Of other columns, and
of pair tables too large to list, only cells that hold a row get noise, and only those above a threshold are released: a cell that
only one row fills passes it with a chance that is part of ``delta`` (a stability-based histogram). So domains of any size
work, and categories found in the data are covered.

Not covered by the guarantee: cleaning and imputing with statistics of the raw data before fitting. The number of rows counts as
public. Leave ``seed`` at None for real releases.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.values import as_number, nan_to_null
from ..operators.association import pair_counts
from ..operators.roles import ColumnRoles, detect_column_roles
from ..session import materialize
from .fit import edge_counts, prepare_tokens, token_counts
from .ledger import default_delta, epsilon_of, rho_of
from .model import NO_PARENT, Model, intervals, slot_counts
from .noise import add_noise, release_key, threshold
from .tokens import BINS, NULL_TOKEN

LISTED_CELLS = 2_000_000    # a pair table with more cells is not listed: its empty cells stay empty
FALLBACK_TOKENS = 64        # of a child, for parent tokens that no pair was released for
MIN_ROWS = 10
_EXPONENTS = range(-1074, 1025)  # powers of two around any double


def private_bounds(df: DataFrame, columns: Sequence[str], epsilon: float, rng: np.random.Generator) -> dict[str, tuple[float, float]]:
    """Rough ranges of numeric columns: powers of two around the noisy bulk of the values.

    Each row falls in one cell per column, so a column costs ``epsilon / len(columns)``.
    """
    power = lambda x: F.greatest(F.lit(_EXPONENTS[0]), F.least(F.lit(_EXPONENTS[-1]), F.ceil(F.log2(F.abs(x)))))
    entries = []
    for i, c in enumerate(columns):
        x = as_number(c, df.schema[c].dataType)
        entries.append(F.when(x.isNotNull(), F.struct(
            F.lit(i).alias("i"), F.signum(x).cast("int").alias("sign"), F.when(x == 0, 0).otherwise(power(x)).cast("int").alias("power"))))
    counted = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.i", "e.sign", "e.power").count()
    seen = {(r["i"], r["sign"], r["power"]): r["count"] for r in counted.collect()}  # at most 4,199 cells per column
    scale = len(columns) / epsilon
    cells = [(-1, p) for p in reversed(_EXPONENTS)] + [(0, 0)] + [(1, p) for p in _EXPONENTS]
    out = {}
    for i, c in enumerate(columns):
        noisy = [seen.get((i, *cell), 0) + rng.laplace(0.0, scale) for cell in cells]
        floor = scale * np.log(2 * len(cells) / 0.01)  # noise alone stays below this with probability 0.99
        full = [cell for cell, n in zip(cells, noisy) if n > floor] or [(1, 0)]
        power_of_two = lambda p: math.ldexp(1.0, p) if p < 1024 else sys.float_info.max
        edge = lambda cell, up: cell[0] * power_of_two(cell[1] if (cell[0] > 0) == up else cell[1] - 1) if cell[0] else 0.0
        low, high = edge(full[0], False), edge(full[-1], True)
        out[c] = (low, high) if high > low else (low, low + 1.0)
    return out


def fit_private_tree(df: DataFrame, roles: ColumnRoles | None = None, epsilon: float | None = 3.0, delta: float | None = None,
                     sigma: float | None = None, preprocessor_eps: float = 0.0,
                     bounds: dict[str, tuple[float, float]] | None = None, domains: dict[str, Sequence[str]] | None = None,
                     bins: int = BINS, seed: int | None = None) -> Model:
    """Fit with a total budget ``epsilon``, or with noise ``sigma`` and the epsilon reported afterwards.

    Ranges of continuous columns come from ``bounds`` or are bought with
    ``preprocessor_eps``, which is part of ``epsilon``.
    """
    if sigma is None:
        if epsilon is None or epsilon <= 0:
            raise ValueError(f"epsilon must be positive, got {epsilon}")
        if not 0.0 <= preprocessor_eps < epsilon:
            raise ValueError("preprocessor_eps must be in [0, epsilon)")
    elif sigma <= 0:
        raise ValueError(f"sigma must be positive, got {sigma}")
    clean = nan_to_null(df)
    rows = clean.count()
    if rows < MIN_ROWS:
        raise ValueError(f"{rows} rows are too few; at least {MIN_ROWS} are needed")
    delta = delta or default_delta(rows)
    rng, key = np.random.default_rng(seed), release_key(seed)
    roles = roles or detect_column_roles(clean)
    names = roles.classified
    numbers = [c for c in names if c in roles.continuous]
    given = dict(bounds or {})
    releases: list[dict] = []
    unknown = [c for c in numbers if c not in given]
    if unknown:
        if preprocessor_eps <= 0:
            raise ValueError(f"give bounds for {unknown}, or a preprocessor_eps to find them privately")
        given.update(private_bounds(clean, unknown, preprocessor_eps, rng))
        releases.append({"release": "bounds", "columns": ",".join(unknown), "rho": 0.0, "epsilon": preprocessor_eps})
    edges = {c: np.linspace(*given[c], bins + 1).tolist() for c in numbers}
    specs, tokens, _ = prepare_tokens(clean, roles, bins, edges)
    d, links = len(names), max(len(names) - 1, 0)
    listed = {s.name: s.tokens for s in specs if s.continuous}
    listed |= {c: list(dict.fromkeys([*map(str, domains[c]), NULL_TOKEN])) for c in names if c not in listed and domains and c in domains}
    unlisted = [c for c in names if c not in listed]
    # a part of delta is kept for what thresholds let through
    sparse = len(unlisted) + links
    thresholds_needed = bool(unlisted) or any(len(listed[a]) * len(listed[b]) > LISTED_CELLS for a, b in combinations(names, 2))
    accounted = delta / 2 if thresholds_needed else delta
    passing = delta / 2 / max(1, sparse)
    if sigma is None:
        rho = rho_of(epsilon - sum(r["epsilon"] for r in releases), accounted)
        part = rho / (3 if links else 1)
        sigma_one, rho_choice, sigma_two = np.sqrt(d / (2 * part)), part, np.sqrt(links / (2 * part)) if links else 0.0
    else:
        sigma_one = sigma_two = sigma
        rho_choice = links / (2 * sigma ** 2)

    # 1. one noisy histogram per column
    histograms = materialize(_histograms(token_counts(tokens, names), listed, unlisted, sigma_one, passing, key), "histograms")
    facts = {r["target"]: r for r in histograms.groupBy("target").agg(F.sum("n").alias("sum"), F.count(F.lit(1)).alias("size")).collect()}
    sums = {c: facts[c]["sum"] for c in names}
    releases += [{"release": "histogram", "columns": c, "rho": 1 / (2 * sigma_one ** 2), "epsilon": 0.0} for c in names]

    # 2. links, by the exponential mechanism on how far a pair is from independence
    order: list[tuple[str, str | None]] = [(names[0], None)]
    counts = histograms.where(F.col("target") == names[0]).select("target", F.lit(NO_PARENT).alias("parent_token"), "token", "n")
    if links:
        pairs = list(combinations(names, 2))
        table = materialize(pair_counts(tokens, pairs), "pairs")
        score = _dependence(table, pairs, histograms, sums)
        strength = np.sqrt(8 * rho_choice / links)
        done = {names[0]}
        while len(done) < d:
            options = [(a, b) for a in names if a in done for b in names if b not in done]
            loud = [strength * score[p if p in score else p[::-1]] / 2 + rng.gumbel() for p in options]
            parent, child = options[int(np.argmax(loud))]
            done.add(child)
            order.append((child, parent))
            releases.append({"release": "link", "columns": f"{parent},{child}", "rho": rho_choice / links, "epsilon": 0.0})
        # 3. one noisy pair table per link
        counts = counts.unionByName(_pair_tables(edge_counts(table, pairs, order), order, histograms, listed, sigma_two, passing, key))
        releases += [{"release": "pair table", "columns": f"{parent},{child}", "rho": 1 / (2 * sigma_two ** 2), "epsilon": 0.0} for child, parent in order[1:]]
    cells = materialize(intervals(materialize(counts, "released")), "model")
    rho_spent = sum(r["rho"] for r in releases)
    spent = sum(r["epsilon"] for r in releases) + epsilon_of(rho_spent, accounted)
    return Model("dp_tree", specs, order, cells, slot_counts(cells), rows, seed,
                 dp_config={"is_dp_enabled": True, "epsilon_initial": epsilon if sigma is None else None, "preprocessor_eps": preprocessor_eps,
                            "sigma": float(sigma_one), "delta": delta, "delta_accounted": accounted, "domain_from_data": bool(unlisted)},
                 dp_spent={"spent_epsilon_final": spent, "epochs_requested": len(releases), "epochs_completed": len(releases)},
                 releases=[{**r, "rho": float(r["rho"])} for r in releases])


def _listed_frame(spark, listed: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(c, t) for c, tokens in listed.items() for t in tokens], "target string, token string")


def _histograms(counts: DataFrame, listed: dict[str, list[str]], unlisted: list[str], sigma: float, passing: float, key: bytes) -> DataFrame:
    """``(target, token, n)`` with noise, n positive; a column of which nothing is left gets its tokens once, or that of a missing value."""
    spark = counts.sparkSession
    all_cells = _listed_frame(spark, listed).join(counts.select("target", "token", "n"), ["target", "token"], "left").fillna(0, ["n"])
    found = counts.where(F.col("target").isin(unlisted)).select("target", "token", "n")
    noisy = add_noise(all_cells, "histogram", ["target", "token"], sigma, key).where("n > 0").unionByName(
        add_noise(found, "histogram", ["target", "token"], sigma, key).where(F.col("n") > threshold(sigma, passing)))
    noisy = materialize(noisy, "noisy")
    there = {r["target"] for r in noisy.select("target").distinct().collect()}  # one row per column
    empty = {c: listed.get(c, [NULL_TOKEN]) for c in [*listed, *unlisted] if c not in there}
    return noisy.unionByName(_listed_frame(spark, empty).withColumn("n", F.lit(1).cast("long"))) if empty else noisy


def _dependence(table: DataFrame, pairs, histograms: DataFrame, sums: dict[str, int]) -> dict[tuple[str, str], float]:
    """L1 distance of every pair table from the product of its noisy histograms. One added row
    changes it by at most one."""
    total = float(np.mean(list(sums.values()))) or 1.0
    names = F.broadcast(table.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, left string, right string"))
    side = lambda s, t, m: histograms.select(F.col("target").alias(s), F.col("token").alias(t), F.col("n").cast("double").alias(m))
    joined = (table.join(names, "pair").join(side("left", "a", "ma"), ["left", "a"], "left").join(side("right", "b", "mb"), ["right", "b"], "left"))
    expected = F.coalesce(F.col("ma") * F.col("mb") / total, F.lit(0.0))
    gaps = joined.groupBy("pair").agg(F.sum(F.abs(F.col("n") - expected) - expected).alias("g"))
    found = {r["pair"]: r["g"] for r in gaps.collect()}  # one row per pair of columns
    return {p: found.get(i, 0.0) + sums[p[0]] * sums[p[1]] / total for i, p in enumerate(pairs)}


def _pair_tables(counts: DataFrame, order, histograms: DataFrame, listed: dict[str, list[str]], sigma: float, passing: float, key: bytes) -> DataFrame:
    """``(target, parent_token, token, n)`` with noise, n positive, for every link.

    Tokens that the histograms lack are left out, so that what is drawn as a child is known as a parent. A parent token of which
    nothing is left takes its child's largest histogram cells instead.
    """
    spark = counts.sparkSession
    cells, names = ["target", "parent_token", "token"], ["target", "parent_token", "token"]
    dense = [(child, parent) for child, parent in order[1:] if child in listed and parent in listed and len(listed[child]) * len(listed[parent]) <= LISTED_CELLS]
    others = [child for child, parent in order[1:] if (child, parent) not in dense]
    parts = []
    known = histograms.select("target", "token")    # released before
    if dense:
        children = spark.createDataFrame([(child, parent, listed[child]) for child, parent in dense], "target string, parent string, tokens array<string>")
        parents = _listed_frame(spark, {p: listed[p] for _, p in dense}).select(F.col("target").alias("parent"), F.col("token").alias("parent_token"))
        grid = parents.join(children, "parent").select("target", "parent_token", F.explode("tokens").alias("token"))
        parts.append(add_noise(grid.join(counts, cells, "left").fillna(0, ["n"]), "pair", names, sigma, key).where("n > 0")
                     .join(known, ["target", "token"], "left_semi").select(*cells, "n"))
    if others:
        pairs = spark.createDataFrame([(child, parent) for child, parent in order[1:] if child in others], "target string, parent string")
        found = (counts.join(F.broadcast(pairs), "target")  # one row per column
                 .join(known.select(F.col("target").alias("parent"), F.col("token").alias("parent_token")), ["parent", "parent_token"], "left_semi")
                 .join(known, ["target", "token"], "left_semi").select(*cells, "n"))
        parts.append(add_noise(found, "pair", names, sigma, key).where(F.col("n") > threshold(sigma, passing)))
    noisy = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    noisy = materialize(noisy, "edges")
    links = F.broadcast(spark.createDataFrame(order[1:], "target string, parent string"))   # one row per column
    bare = (histograms.select(F.col("target").alias("parent"), F.col("token").alias("parent_token")).join(links, "parent")
            .join(noisy.select("target", "parent_token").distinct(), ["target", "parent_token"], "left_anti"))
    largest = Window.partitionBy("target").orderBy(F.desc("n"), "token")
    common = histograms.withColumn("place", F.row_number().over(largest)).where(F.col("place") <= FALLBACK_TOKENS)
    instead = common.groupBy("target").agg(F.collect_list(F.struct("token", "n")).alias("cells"))   # at most 64 each
    return noisy.unionByName(bare.join(F.broadcast(instead), "target").select("target", "parent_token", F.explode("cells").alias("c"))
                             .select("target", "parent_token", "c.token", "c.n"))
