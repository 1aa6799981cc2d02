"""PASS / FAIL / PARTIAL verdicts, for any number of runs at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class Thresholds:
    max_utility_loss: float = 0.25
    max_mean_jsd: float = 0.40
    max_mia_auc: float = 0.55
    require_dcr_privacy_preserved: bool = True
    require_dp_enabled: bool = True
    max_spent_epsilon: float | None = None
    strict_dp: bool = False  # also fail when it is unknown whether DP was on


METRICS = {
    "has_utility": "boolean", "has_privacy": "boolean", "has_dp": "boolean",
    "utility_loss": "double", "mean_jsd": "double", "attack_auc": "double",
    "dcr_privacy_preserved": "boolean", "is_dp_enabled": "boolean", "spent_epsilon": "double",
}


def _above(metric: str, label: str, limit: float, digits: int, note: str = "") -> Column:
    """Issue text when a metric is above its limit or not a number."""
    value = F.col(metric)
    text = F.format_string(f"{label} %.{digits}f > threshold {limit}{note}", value)
    return F.when(F.isnan(value), F.lit(f"{label} is not a number")).when(value > limit, text)


def verdict(runs: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Add ``overall, utility_ok, privacy_ok, dp_ok, issues`` to rows of metrics.

    ``runs`` has the columns of ``METRICS`` (``has_…``: was that report made at all).
    A check is NULL without its report. FAIL if any check fails, else PARTIAL if any
    is NULL, else PASS. Only values above a limit fail; a missing value does not.
    """
    utility = [_above("utility_loss", "Utility Loss", limits.max_utility_loss, 3),
               _above("mean_jsd", "Mean JSD", limits.max_mean_jsd, 4)]
    privacy = [_above("attack_auc", "MIA AUC", limits.max_mia_auc, 3, " (leak risk)")]
    if limits.require_dcr_privacy_preserved:
        privacy.append(F.when(~F.col("dcr_privacy_preserved"), "DCR: synthetic rows are too close to the training rows"))
    dp: list[Column] = []
    if limits.require_dp_enabled:
        enabled = F.coalesce("is_dp_enabled", F.lit(False)) if limits.strict_dp else F.col("is_dp_enabled")
        dp.append(F.when(~enabled, "DP is disabled"))
    if limits.max_spent_epsilon is not None:
        dp.append(_above("spent_epsilon", "Spent epsilon", limits.max_spent_epsilon, 3))
    none = F.array().cast("array<string>")
    found = lambda present, issues: F.when(
        F.col(present), F.array_compact(F.array(*issues)) if issues else none)
    lists = runs.withColumns({"__u": found("has_utility", utility), "__p": found("has_privacy", privacy), "__d": found("has_dp", dp)})
    checks = lists.withColumns({ok: F.when(F.col(i).isNotNull(), F.size(i) == 0)
                                 for ok, i in (("utility_ok", "__u"), ("privacy_ok", "__p"), ("dp_ok", "__d"))})
    failed = ~F.coalesce("utility_ok", F.lit(True)) | ~F.coalesce("privacy_ok", F.lit(True)) | ~F.coalesce("dp_ok", F.lit(True))
    partial = F.col("utility_ok").isNull() | F.col("privacy_ok").isNull() | F.col("dp_ok").isNull()
    issues = F.concat(*[F.coalesce(c, none) for c in ("__u", "__p", "__d")])
    return checks.withColumn("overall", F.when(failed, "FAIL").when(partial, "PARTIAL").otherwise("PASS")) \
        .withColumn("issues", issues).drop("__u", "__p", "__d")


# ------------------------------------------------------- flat views of reports

def nested(schema: T.DataType, root: str, path: str, as_type: str) -> Column:
    """A field deep inside a struct column, or NULL if the report does not have it."""
    at, kind = F.col(root), schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return F.lit(None).cast(as_type)
        at, kind = at.getField(name), kind[name].dataType
    return at.cast(as_type)


# Flat name → place in the nested report and type.
PRIVACY_FIELDS = {
    "mia_auc": ("empirical_risk.membership_inference.attack_auc", "double"),
    "dcr_privacy_preserved": ("empirical_risk.distance_metrics.dcr.privacy_preserved", "boolean"),
    "dcr_synth_median": ("empirical_risk.distance_metrics.dcr.synth_to_real.median", "double"),
    "dcr_holdout_median": ("empirical_risk.distance_metrics.dcr.holdout_to_real.median", "double"),
    "spent_epsilon": ("dp_guarantees.spent_epsilon_final", "double"),
    "epochs_completed": ("dp_guarantees.epochs_completed", "int"),
    "k_anonymity": ("diagnostic.classical.k_anonymity", "long"),
    "l_diversity": ("diagnostic.classical.l_diversity", "long"),
    "t_closeness": ("diagnostic.classical.t_closeness", "double"),
}
UTILITY_FIELDS = {
    "trtr_f1": ("ml_efficacy.trtr.f1_weighted", "double"),
    "tstr_f1": ("ml_efficacy.tstr.f1_weighted", "double"),
    "utility_loss": ("ml_efficacy.utility_loss.value", "double"),
    "mean_jsd": ("statistical.summary.mean_jsd", "double"),
    "mean_tvd": ("statistical.summary.mean_tvd", "double"),
    "pearson_corr_mae": ("correlations.pearson_corr_mae", "double"),
}
DP_FIELDS = {
    "is_dp_enabled": ("dp_config.is_dp_enabled", "boolean"),
    "epsilon_initial": ("dp_config.epsilon_initial", "double"),
    "delta": ("dp_config.delta", "double"),
    "spent_epsilon_final": ("dp_spent.spent_epsilon_final", "double"),
    "epochs_completed": ("dp_spent.epochs_completed", "int"),
    "epochs_requested": ("dp_spent.epochs_requested", "int"),
}


def _flat(df: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> list[Column]:
    kind = df.schema[column].dataType
    return [nested(kind, column, path, t).alias(name) for name, (path, t) in fields.items()]


def flatten_privacy_metrics(df: DataFrame, column: str = "privacy", keep: tuple[str, ...] = ()) -> DataFrame:
    """Key metrics of nested privacy reports as flat columns."""
    return df.select(*keep, *_flat(df, column, PRIVACY_FIELDS))


def flatten_utility_metrics(df: DataFrame, column: str = "utility", keep: tuple[str, ...] = ()) -> DataFrame:
    """Key metrics of nested utility reports as flat columns."""
    return df.select(*keep, *_flat(df, column, UTILITY_FIELDS))


def dp_guarantees(df: DataFrame, column: str = "dp_report", keep: tuple[str, ...] = ()) -> DataFrame:
    """``available`` and the six budget fields of generator reports."""
    return df.select(*keep, F.col(column).isNotNull().alias("available"), *_flat(df, column, DP_FIELDS))
