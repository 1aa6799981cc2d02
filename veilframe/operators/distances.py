"""Distance-based privacy: closest records, neighbour ratios, membership inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import row_hash
from ..functions.ordered import running_totals
from ..functions.quantiles import exact_quantiles
from ..session import materialize
from .efficacy import UNLIMITED_DEPTH
from .encode import Encoder, common_columns, encode, fit_encoder
from .neighbours import fold, nearest_two
from .split import sample_rows


def dcr(query: DataFrame, reference: DataFrame, keep: Sequence[str] = (), fit_on: DataFrame | None = None,
        columns: Sequence[str] | None = None, broadcast_values: int | None = None) -> DataFrame:
    """Per query row its ``keep`` columns, ``dcr`` (distance to the closest reference
    record) and ``d2`` (distance to the second closest).

    Ranges and dictionary come from ``fit_on``, by default the reference. ``columns``
    limits the compared columns; identifiers should be left out. ``broadcast_values`` as in ``nearest_two``.
    """
    used = list(columns) if columns is not None else [c for c in common_columns(reference, query) if c not in keep]
    encoder = fit_encoder((fit_on or reference).select(*used))
    rows = materialize(encode(query, encoder, keep), "rows")
    near = nearest_two(fold(rows).select("num", "cat"), fold(encode(reference, encoder)), broadcast_values)
    near = near.select(F.col("num").alias("__num"), F.col("cat").alias("__cat"), F.col("d1").alias("dcr"), "d2")
    # sorting by a number first spares comparing arrays; + 0.0 makes of -0.0 the 0.0 that grouping makes of it
    place = lambda num, cat: F.xxhash64(F.transform(num, lambda x: x + F.lit(0.0)), cat)
    same = (place("num", "cat") == place("__num", "__cat")) & (F.col("num") == F.col("__num")) & (F.col("cat") == F.col("__cat"))
    return rows.join(near, same).select(*keep, "dcr", "d2")


def shared_encoder(train: DataFrame, holdout: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None) -> Encoder:
    """Encoder fitted on train for the given columns, by default those all three tables have."""
    used = list(columns) if columns is not None else [c for c in common_columns(train, synth) if c in holdout.columns]
    return fit_encoder(train.select(*used))


def distance_frame(train: DataFrame, holdout: DataFrame, synth: DataFrame, columns: Sequence[str] | None = None,
                   encoder: Encoder | None = None) -> DataFrame:
    """Distances of synthetic and holdout vectors to train, searched once and written out:
    ``d1, d2, synth_rows, holdout_rows`` (how many rows each vector stands for)."""
    encoder = encoder or shared_encoder(train, holdout, synth, columns)
    both = encode(synth, encoder, [F.lit(1).alias("s")]).unionByName(encode(holdout, encoder, [F.lit(0).alias("s")]))
    queries = fold(both, synth_rows=F.col("s"), holdout_rows=1 - F.col("s"))
    near = nearest_two(queries, fold(encode(train, encoder)))
    return materialize(near.select("d1", "d2", "synth_rows", "holdout_rows"), "distances")


def nndr_ratio():
    """d1 / d2, and 0 where d2 is 0."""
    return F.when(F.col("d2") > 0, F.col("d1") / F.col("d2")).otherwise(0.0)


def distance_summary(distances: DataFrame) -> DataFrame:
    """One row with everything below: ``dcr_summary`` and ``nndr_summary`` in the same passes."""
    part = distances.select(F.col("d1").alias("synth"), F.col("d1").alias("holdout"), nndr_ratio().alias("ratio"),
                            "synth_rows", "holdout_rows")
    facts: dict[str, dict] = {}
    cuts = exact_quantiles(part, {"synth": [0.5, 0.05], "holdout": [0.5, 0.05], "ratio": [0.5]},
                           {"synth": "synth_rows", "holdout": "holdout_rows", "ratio": "synth_rows"}, facts)
    number = lambda v: F.lit(v).cast("double")
    values = []
    for side in ("synth", "holdout"):
        found = {"min": facts[side]["min"], "median": cuts[side][0], "mean": facts[side]["mean"], "p5": cuts[side][1]}
        values += [F.round(number(v), 6).alias(f"{side}_{n}") for n, v in found.items()]
    w = F.col("synth_rows")
    share = F.sum(F.when(F.col("ratio") < 0.1, w).otherwise(0)) / F.sum(w)
    return part.agg(*values, (number(cuts["synth"][0]) >= number(cuts["holdout"][0])).alias("privacy_preserved"),
                    F.round(number(facts["ratio"]["mean"]), 6).alias("nndr_mean"),
                    F.round(number(cuts["ratio"][0]), 6).alias("nndr_median"), F.round(share, 6).alias("nndr_share_below_0_1"))


def dcr_summary(distances: DataFrame) -> DataFrame:
    """One row: min, median, mean, 5th percentile for synth→train and holdout→train, and
    ``privacy_preserved``: synthetic rows are at the median not closer than holdout rows."""
    whole = distance_summary(distances)
    return whole.select(*[c for c in whole.columns if not c.startswith("nndr_")])


def nndr_summary(distances: DataFrame) -> DataFrame:
    """One row: mean, median and share below 0.1 of the synthetic rows' neighbour ratio."""
    return distance_summary(distances).select(F.col("nndr_mean").alias("synth_mean"), F.col("nndr_median").alias("synth_median"),
                                              F.col("nndr_share_below_0_1").alias("share_below_0_1"))


# ------------------------------------------------------ membership inference

def mia_features(train: DataFrame, holdout: DataFrame, synth: DataFrame, sample_size: int | None = None,
                 seed: int = 42, columns: Sequence[str] | None = None, member_order=None,
                 encoder: Encoder | None = None) -> DataFrame:
    """``distance, members, non_members``: how far equally many train and holdout rows
    are from the closest synthetic row; equal vectors are one row with counts.

    ``sample_size`` optionally bounds the labelled rows an attacker is fitted on; by default the smaller of both
    sides is used whole. The synthetic table is always used whole.
    """
    sizes = train.count(), holdout.count()
    n = min(sizes)
    if sample_size:
        n = min(n, sample_size)
    encoder = encoder or shared_encoder(train, holdout, synth, columns)
    picked = [sample_rows(d, n, seed, order=member_order if member_order is not None else row_hash(d.columns, seed), rows=rows)
              for d, rows in zip((train, holdout), sizes)]
    both = encode(picked[0], encoder, [F.lit(1).alias("m")]).unionByName(encode(picked[1], encoder, [F.lit(0).alias("m")]))
    queries = fold(both, members=F.col("m"), non_members=1 - F.col("m"))
    near = nearest_two(queries, fold(encode(synth, encoder)))
    return materialize(near.select(F.col("d1").alias("distance"), "members", "non_members"), "attack")


def mia_rank_auc(features: DataFrame) -> DataFrame:
    """One row: ``attack_auc``, the probability that a member is closer to the synthetic
    table than a non-member (ties count half), without training a model."""
    by_distance = materialize(features.groupBy("distance").agg(
        F.sum("members").alias("pos"), F.sum("non_members").alias("neg")), "ranked")
    placed = running_totals(by_distance, "distance", {"neg_before": "neg", "pos_before": "pos"})
    wins = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2.0))
    return placed.agg(F.round(wins / (F.sum("pos") * F.sum("neg")), 6).alias("attack_auc"),
                      F.sum("pos").alias("members"), F.sum("neg").alias("non_members"))


def interpret_attack(auc):
    """Band of an attack AUC."""
    return (F.when(auc < 0.6, "protected").when(auc < 0.75, "warning").otherwise("risk"))


def membership_inference(features: DataFrame, n_estimators: int = 100, folds: int = 5, seed: int = 42,
                         max_depth: int = UNLIMITED_DEPTH) -> DataFrame:
    """One row: cross-validated ROC-AUC of a random forest that tells members from
    non-members by their distance, its standard deviation over the folds, and a band."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator

    sides = F.array(F.struct(F.lit(1.0).alias("label"), F.col("members").alias("n")),
                    F.struct(F.lit(0.0).alias("label"), F.col("non_members").alias("n")))
    rows = (features.select("distance", F.explode(sides).alias("side")).where("side.n > 0")
            .select("distance", "side.label", F.explode(F.sequence(F.lit(1), F.col("side.n"))).alias("copy"))
            .withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "distance", "label", "copy"), F.lit(folds)).cast("int")))
    ready = VectorAssembler(inputCols=["distance"], outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=n_estimators, maxDepth=max_depth, seed=seed)
    cv = CrossValidator(estimator=forest, estimatorParamMaps=[{}], evaluator=BinaryClassificationEvaluator(),
                        numFolds=folds, foldCol="fold", parallelism=folds).fit(
        ready.select("features", "label", "fold"))
    tested = features.agg(F.sum("members").alias("n_members_tested"), F.sum("non_members").alias("n_non_members_tested"))
    auc = F.lit(float(cv.avgMetrics[0]))
    return tested.select(F.round(auc, 4).alias("attack_auc"), F.round(F.lit(float(cv.stdMetrics[0])), 4).alias("attack_auc_std"),
                         interpret_attack(auc).alias("interpretation"), "n_members_tested", "n_non_members_tested")
