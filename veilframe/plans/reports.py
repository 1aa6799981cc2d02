"""Privacy and utility reports as one row of nested columns, and the final report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators import anonymity, association, distances, efficacy, marginals
from ..operators.verdict import DP_FIELDS, Thresholds, verdict
from ..session import materialize


@dataclass(frozen=True)
class PrivacyConfig:
    quasi_identifiers: Sequence[str] = field(default_factory=tuple)
    sensitive_attribute: str | None = None
    compute_classical: bool = True
    compute_distance: bool = True
    compute_mia: bool = True
    mia_sample_size: int | None = None   # None: all rows of the smaller side
    mia_n_estimators: int = 100
    columns: Sequence[str] | None = None  # compared columns; None: all shared ones
    seed: int = 42


@dataclass(frozen=True)
class UtilityConfig:
    target: str
    task: str = "classification"
    compute_statistical: bool = True
    compute_correlations: bool = True
    compute_ml_efficacy: bool = True
    n_estimators: int = 100
    max_depth: int | None = None
    drop: Sequence[str] = field(default_factory=tuple)
    seed: int = 42


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct value in another plan."""
    return df.select(F.struct("*")).scalar()


def _rows(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def privacy_report(train: DataFrame, holdout: DataFrame, synth: DataFrame, config: PrivacyConfig = PrivacyConfig(),
                   dp_report: DataFrame | None = None) -> DataFrame:
    """One row: metadata, dp_guarantees, empirical_risk (distances, attack) and diagnostic (k/l/t).

    Groups switched off are NULL. k/l/t compare the synthetic table with train and
    holdout together.
    """
    metadata = F.struct(_rows(train).alias("real_train_rows"), _rows(holdout).alias("real_holdout_rows"), _rows(synth).alias("synth_rows"))
    null = F.lit(None)
    distance = attack = classical = null
    encoder = distances.shared_encoder(train, holdout, synth, config.columns) if config.compute_distance or config.compute_mia else None
    if config.compute_distance:
        frame = distances.distance_frame(train, holdout, synth, encoder=encoder)
        d = one_row(distances.distance_summary(frame))
        side = lambda s: F.struct(*[d[f"{s}_{n}"].alias(n) for n in ("min", "median", "mean", "p5")])
        n = F.struct(*[d[f"nndr_{n}"].alias(a) for n, a in (("mean", "synth_mean"), ("median", "synth_median"),
                                                            ("share_below_0_1", "share_below_0_1"))])
        distance = F.struct(F.struct(side("synth").alias("synth_to_real"), side("holdout").alias("holdout_to_real"),
                                     d["privacy_preserved"].alias("privacy_preserved")).alias("dcr"), n.alias("nndr"))
    if config.compute_mia:
        features = distances.mia_features(train, holdout, synth, config.mia_sample_size, config.seed, encoder=encoder)
        attack = one_row(distances.membership_inference(features, config.mia_n_estimators, seed=config.seed))
    if config.compute_classical and config.quasi_identifiers and config.sensitive_attribute:
        classical = one_row(anonymity.classical_metrics(synth, config.quasi_identifiers, config.sensitive_attribute,
                                                        train.unionByName(holdout)))
    if dp_report is None:
        guarantees = F.struct(F.lit(False).alias("available"))
    else:
        row = one_row(dp_report)
        fields = [F.lit(True).alias("available")]
        for name, (path, kind) in DP_FIELDS.items():
            fields.append(_pick(row, dp_report.schema, path, kind).alias(name))
        guarantees = F.struct(*fields)
    return train.sparkSession.range(1).select(
        metadata.alias("metadata"), guarantees.alias("dp_guarantees"),
        F.struct(distance.alias("distance_metrics"), attack.alias("membership_inference")).alias("empirical_risk"),
        F.struct(classical.alias("classical")).alias("diagnostic"))


def _pick(row: Column, schema: T.StructType, path: str, kind: str) -> Column:
    at, here = row, schema
    for name in path.split("."):
        if not isinstance(here, T.StructType) or name not in here.names:
            return F.lit(None).cast(kind)
        at, here = at.getField(name), here[name].dataType
    return at.cast(kind)


def utility_report(train: DataFrame, synth: DataFrame, test: DataFrame, config: UtilityConfig) -> DataFrame:
    """One row: metadata, statistical, correlations, ml_efficacy. The target and the dropped
    columns take no part in the column and pair comparisons."""
    if config.target not in train.columns:
        raise ValueError(f"target column {config.target!r} not found")
    out = {*config.drop, config.target}
    columns = [c for c in train.columns if c not in out]
    metadata = F.struct(_rows(train).alias("real_train_rows"), _rows(synth).alias("synth_rows"), _rows(test).alias("real_test_rows"),
                        F.lit(len(train.columns)).alias("real_columns"), F.lit(config.target).alias("target_column"),
                        F.lit(config.task).alias("task_type"))
    statistical = correlations = ml = F.lit(None)
    if config.compute_statistical:
        compared = materialize(marginals.marginal_report(train, synth, columns), "marginals")
        per_column = compared.agg(F.collect_list(F.struct("kind", "column", "metric", "value"))).scalar()  # a few entries per column
        statistical = F.struct(per_column.alias("columns"), one_row(marginals.summary_of(compared)).alias("summary"))
    if config.compute_correlations:
        correlations = F.struct(association.pearson_mae(train, synth, columns).select("pearson_corr_mae").scalar().alias("pearson_corr_mae"),
                                association.cramers_v_mae(train, synth, columns).scalar().alias("cramers_v_mae"))
    if config.compute_ml_efficacy:
        setup = efficacy.EfficacyConfig(config.target, config.task, config.n_estimators, config.max_depth, config.seed, config.drop)
        row = efficacy.ml_efficacy(train, synth, test, setup)
        e = one_row(row)
        scores = lambda p: F.struct(*[e[c].alias(c[5:]) for c in row.columns if c.startswith(p)])
        ml = F.struct(scores("trtr_").alias("trtr"), scores("tstr_").alias("tstr"),
                      F.struct(e["loss_metric"].alias("metric"), e["utility_loss"].alias("value"),
                               e["interpretation"].alias("interpretation")).alias("utility_loss"))
    return train.sparkSession.range(1).select(metadata.alias("metadata"), statistical.alias("statistical"),
                                              correlations.alias("correlations"), ml.alias("ml_efficacy"))


def metrics_of(utility: DataFrame | None, privacy: DataFrame | None, dp: DataFrame | None, spark) -> DataFrame:
    """The columns a verdict needs, from one-row reports; a report may be missing."""
    def take(report: DataFrame | None, path: str, kind: str) -> Column:
        return F.lit(None).cast(kind) if report is None else _pick(one_row(report), report.schema, path, kind)

    return spark.range(1).select(
        F.lit(utility is not None).alias("has_utility"), F.lit(privacy is not None).alias("has_privacy"), F.lit(dp is not None).alias("has_dp"),
        take(utility, "ml_efficacy.utility_loss.value", "double").alias("utility_loss"),
        take(utility, "statistical.summary.mean_jsd", "double").alias("mean_jsd"),
        take(privacy, "empirical_risk.membership_inference.attack_auc", "double").alias("attack_auc"),
        take(privacy, "empirical_risk.distance_metrics.dcr.privacy_preserved", "boolean").alias("dcr_privacy_preserved"),
        take(dp, "dp_config.is_dp_enabled", "boolean").alias("is_dp_enabled"),
        take(dp, "dp_spent.spent_epsilon_final", "double").alias("spent_epsilon"))


def final_report(utility: DataFrame | None, privacy: DataFrame | None, dp: DataFrame | None, limits: Thresholds = Thresholds(),
                 minimization: DataFrame | None = None, dataset: str = "unknown", generator: str = "unknown",
                 process_id: str | None = None, spark=None) -> DataFrame:
    """One row: ids, time, verdict, minimisation, generator, utility, privacy."""
    spark = spark or next(d for d in (utility, privacy, dp) if d is not None).sparkSession
    judged = verdict(metrics_of(utility, privacy, dp, spark), limits)
    part = lambda d: F.lit(None) if d is None else one_row(d)
    return judged.select(
        F.lit(str(uuid4())).alias("report_id"), F.lit(process_id).alias("process_id"),
        F.lit(datetime.now(timezone.utc).isoformat()).alias("generated_at"), F.lit(dataset).alias("dataset_name"),
        F.lit(generator).alias("generator_type"), F.struct("overall", "utility_ok", "privacy_ok", "dp_ok", "issues").alias("verdict"),
        F.struct(part(minimization).alias("minimization")).alias("data_processing"),
        part(dp).alias("generator"), part(utility).alias("utility"), part(privacy).alias("privacy"))


def scorecard(train: DataFrame, holdout: DataFrame, synth: DataFrame, qi: Sequence[str], sensitive: str,
              columns: Sequence[str] | None = None) -> DataFrame:
    """Long form ``(section, column, metric, value)`` of all measures that need no trained model."""
    def long(df: DataFrame, section: str) -> DataFrame:
        wide = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
        return wide.unpivot([], wide.columns, "metric", "value").select(F.lit(section).alias("section"), F.lit("").alias("column"), "metric", "value")

    encoder = distances.shared_encoder(train, holdout, synth, columns)
    frame = distances.distance_frame(train, holdout, synth, encoder=encoder)
    attack = distances.mia_rank_auc(distances.mia_features(train, holdout, synth, encoder=encoder))
    compared = materialize(marginals.marginal_report(train, synth, columns), "marginals")
    parts = [
        compared.select(F.col("kind").alias("section"), "column", "metric", "value"), long(marginals.summary_of(compared), "summary"),
        long(association.pearson_mae(train, synth, columns), "correlation"), long(association.cramers_v_mae(train, synth, columns), "correlation"),
        long(anonymity.classical_metrics(synth, qi, sensitive, train.unionByName(holdout)), "anonymity"),
        long(distances.distance_summary(frame), "distance"), long(attack, "attack")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
