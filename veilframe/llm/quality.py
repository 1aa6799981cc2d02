"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The Gaussian kernel between standardised statistics is approximated by cosines at random frequencies. The normal
equations of the ridge fit are sums over documents: every task adds up its own, and their sums are added. They are kept
by fold, so that every labelled document also gets the score of a fit that has not seen it; on these scores Spark's
isotonic regression learns what a score means.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import hashed_share, materialize, q, small_side, text_or_empty
from .text_stats import STATS, stats_column, stats_of

FEATURES = 256
WIDTH = 4.0             # of the kernel, in standard deviations of a statistic
RIDGE = 1e-3            # times the number of documents
TRAIN_ROWS = 60_000     # labelled documents used for fitting, about (a documented bound; scores cover all documents)
FOLDS = 4
FIT_TASKS = 4
SEED = 11


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray       # calibration: scores …
    levels: np.ndarray      # … and what they mean


def fourier(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = np.clip((rows - mean) / scale, -8, 8)
    return np.hstack((np.ones((len(z), 1)), z / np.sqrt(len(STATS)), np.cos(z @ frequencies + phases) * np.sqrt(2 / len(phases))))


def raw_scores(rows: np.ndarray, model: Model) -> np.ndarray:
    return fourier(rows, model.mean, model.scale, model.frequencies, model.phases) @ model.weights


def calibrated(raw: np.ndarray, model: Model) -> np.ndarray:
    """Between 0 and 1; a small part follows the raw score, so that what calibration makes equal keeps its order."""
    level = np.interp(raw, model.steps, model.levels)
    return np.clip(0.998 * level + 0.002 / (1 + np.exp(-4 * np.clip(raw - 0.5, -50, 50))), 0.0, 1.0)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(q(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, id_col: str = "doc_id", bound: int = TRAIN_ROWS) -> DataFrame:
    """``(id, y)`` of about ``bound`` labelled rows at most that may be learnt from; null and other labels are left out."""
    usable = labels.where(q(id_col).isNotNull() & q(label).isin(0, 1) & ~held_out(id_col))
    total = usable.count()
    return usable.where(hashed_share([q(id_col)], 0.95 * bound / max(1, total))).select(
        q(id_col).alias("id"), q(label).cast("double").alias("y")).groupBy("id").agg(F.max("y").alias("y"))


def _equations(mean, scale, frequencies, phases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            rows = np.array(batch.column(0).to_pylist(), float).reshape(-1, len(STATS))
            y, folds = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for fold in np.unique(folds):
                mine = folds == fold
                x = fourier(rows[mine], mean, scale, frequencies, phases)
                a, b = sums.get(fold, (0.0, 0.0))
                sums[fold] = [a + x.T @ x, b + x.T @ y[mine]]
        if sums:
            yield pa.RecordBatch.from_pydict({"fold": pa.array([int(f) for f in sums], pa.int32()),
                                              "a": pa.array([a.tobytes() for a, _ in sums.values()], pa.binary()),
                                              "b": pa.array([b.tobytes() for _, b in sums.values()], pa.binary())})

    return run


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = max(a[0, 0], 1.0)
    penalty = np.full(len(b), RIDGE * n)
    penalty[0] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        features: int = FEATURES, bound: int = TRAIN_ROWS, seed: int = SEED) -> Model | None:
    """Learn from the labelled documents that are not held out; None if there is not one document of each label."""
    sample = materialize(labelled_sample(labels, label, id_col, bound), "labelled")
    rows = materialize(docs.select(q(id_col).alias("id"), text_or_empty(text_col).alias("text"))
                       .join(small_side(sample, 24), "id").select("id", "y", stats_column()("text").alias("stats")), "stats")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"),
                     *[e for k in range(len(STATS)) for e in (F.avg(F.col("stats")[k]).alias(f"m{k}"), F.stddev_pop(F.col("stats")[k]).alias(f"s{k}"))]).first()
    if not facts["n"] or facts["y"] in (0.0, 1.0):
        return None
    mean = np.array([facts[f"m{k}"] for k in range(len(STATS))])
    scale = np.array([max(facts[f"s{k}"], 1e-3) for k in range(len(STATS))])
    draw = np.random.Generator(np.random.PCG64(seed))
    frequencies = draw.normal(0, 1 / WIDTH, (len(STATS), features))
    phases = draw.uniform(0, 2 * np.pi, features)
    folded = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(FOLDS)).cast("int"))
    # the sample is bounded, so are the sums that come to the driver: a matrix for each fold of a few tasks
    sums = (folded.select("stats", "y", "fold").coalesce(FIT_TASKS)
            .mapInArrow(_equations(mean, scale, frequencies, phases), "fold int, a binary, b binary").collect())
    size = 1 + len(STATS) + features
    a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
    for r in sorted(sums):
        a[r["fold"]] += np.frombuffer(bytes(r["a"])).reshape(size, size)
        b[r["fold"]] += np.frombuffer(bytes(r["b"]))
    model = Model(mean, scale, frequencies, phases, _solve(a.sum(0), b.sum(0)), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    others = [model._replace(weights=_solve(a.sum(0) - a[f], b.sum(0) - b[f])) for f in range(FOLDS)]
    scored = folded.select(_raw_column(others)("stats", "fold").alias("features"), F.col("y").alias("label"))
    fitted = IsotonicRegression(featuresCol="features", labelCol="label").fit(materialize(scored, "scored"))
    return model._replace(steps=np.array(fitted.boundaries.toArray()), levels=np.array(fitted.predictions.toArray()))


def _raw_column(models: list[Model]):
    @F.arrow_udf(T.DoubleType())
    def raw(stats: pa.Array, folds: pa.Array) -> pa.Array:
        rows, folds = np.array(stats.to_pylist(), float).reshape(-1, len(STATS)), folds.to_numpy()
        out = np.zeros(len(rows))
        for fold in np.unique(folds):
            out[folds == fold] = raw_scores(rows[folds == fold], models[fold])
        return pa.array(out)

    return raw


def score_column(model: Model | None):
    """Column function: text → score between 0 and 1; 0.5 where nothing could be learnt."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.full(len(texts), 0.5))
        return pa.array(calibrated(raw_scores(stats_of(texts), model), model))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.5, **options) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Scores depend on the text only. Null and empty texts are scored alike, as a text with all statistics 0; a null id is
    not held out and never learnt from. Without labels of both kinds every score is 0.5. Repeated rows each get their score; an
    empty table gives an empty result.
    """
    model = fit(docs, labels, label, id_col, text_col, **options)
    return (docs.select(q(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
            .select("doc_id", "held_out", score_column(model)("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
              threshold: float = 0.5, **options) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns. Rules as in ``quality_scores``."""
    model = fit(docs, labels, label, id_col, text_col, **options)
    return docs.where(score_column(model)(text_or_empty(text_col)) >= threshold)
