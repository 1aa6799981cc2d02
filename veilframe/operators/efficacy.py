"""Train on real or synthetic rows, test on the same held-out real rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import dense_codes
from ..functions.values import as_number, is_numeric, q
from ..session import materialize
from .clean import FillValues
from ..functions.quantiles import exact_medians
from . import scores

UNLIMITED_DEPTH = 30  # the deepest tree Spark ML grows
LOSS_BAND = 0.1


@dataclass(frozen=True)
class EfficacyConfig:
    target: str
    task: str = "classification"
    n_estimators: int = 100
    max_depth: int | None = None
    seed: int = 42
    drop: Sequence[str] = field(default_factory=tuple)


def encode_labels(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Replace text columns by their rank among the values of both frames (0, 1, … as BIGINT).

    Missing texts are the value "nan". The code table is joined, so its size is
    no concern of the driver's.
    """
    if not columns:
        return train, test
    text = {c: F.coalesce(q(c).cast("string"), F.lit("nan")) for c in columns}
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text[c].alias("value")) for c in columns])).alias("e")
    values = train.select(entries).unionByName(test.select(entries)).select("e.*")
    codes = materialize(dense_codes(values, "column", "value"), "labels")

    def coded(df: DataFrame) -> DataFrame:
        out = df
        for i, c in enumerate(columns):
            part = codes.where(F.col("column") == c).select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__k{i}"))
            out = out.join(part, text[c] == F.col(f"__v{i}"), "left")
        return out.select(*[F.col(f"__k{list(columns).index(c)}").alias(c) if c in columns else q(c) for c in df.columns])

    return coded(train), coded(test)


def feature_columns(train: DataFrame, test: DataFrame, config: EfficacyConfig) -> list[str]:
    """Shared columns that are neither the target nor dropped, and can be a number."""
    out = {*config.drop, config.target}
    usable = {f.name for f in train.schema.fields if is_numeric(f.dataType) or f.dataType.typeName() in ("string", "boolean")}
    return [c for c in train.columns if c in test.columns and c not in out and c in usable]


def _prepare(train: DataFrame, test: DataFrame, config: EfficacyConfig) -> tuple[DataFrame, DataFrame]:
    """``(label, features)`` of both frames; codes from both, fill values from train only."""
    features = feature_columns(train, test, config)
    texts = [c for c in features if not is_numeric(train.schema[c].dataType)]
    texts_and_target = texts + ([config.target] if config.task == "classification" else [])
    slim = lambda d: d.select(*[q(c) for c in [*features, config.target]]).where(q(config.target).isNotNull())
    a, b = encode_labels(slim(train), slim(test), texts_and_target)
    numbers = [c for c in features if c not in texts]
    fill = FillValues(numeric={k: 0.0 if v is None else v for k, v in exact_medians(slim(train), numbers).items()})
    assembler = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features")

    def ready(d: DataFrame) -> DataFrame:
        d = fill.apply(d)
        cols = [q(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
        label = as_number(config.target, d.schema[config.target].dataType)
        return assembler.transform(d.select(label.alias("label"), *cols)).select("label", "features")

    return ready(a), ready(b)


def run_experiment(train: DataFrame, test: DataFrame, config: EfficacyConfig) -> DataFrame:
    """One row of scores of a random forest: f1_weighted and roc_auc, or mae and r2."""
    fit_rows, test_rows = _prepare(train, test, config)
    depth = config.max_depth if config.max_depth is not None else UNLIMITED_DEPTH
    # a regression tree looks at all features of a node, a classification tree at a random few
    forest = (RandomForestClassifier(featureSubsetStrategy="auto") if config.task == "classification"
              else RandomForestRegressor(featureSubsetStrategy="all"))
    forest.setParams(numTrees=config.n_estimators, maxDepth=depth, seed=config.seed)
    model = forest.fit(materialize(fit_rows, "fit"))
    if config.task != "classification":
        return scores.regression_scores(model.transform(test_rows), "label", "prediction")
    scored = materialize(model.transform(test_rows).select(
        "label", "prediction", vector_to_array("probability").alias("probability")), "scored")
    f1 = scores.weighted_f1(scored, "label", "prediction")
    if model.numClasses == 2:
        auc = scores.roc_auc(scored.withColumn("score", F.col("probability")[1]), F.col("label") == 1, "score")
    else:
        long = scored.select("label", F.posexplode("probability").alias("class", "score")) \
            .withColumn("is_true", F.col("class") == F.col("label"))
        auc = scores.roc_auc_one_vs_rest(long)
    return f1.withColumn("roc_auc", auc.scalar())


def ml_efficacy(train: DataFrame, synth: DataFrame, test: DataFrame, config: EfficacyConfig) -> DataFrame:
    """One row: scores of both experiments (``trtr_…`` trained on real, ``tstr_…`` trained on
    synthetic rows), the utility loss on the main score, and its band."""
    main = "f1_weighted" if config.task == "classification" else "r2"
    rows = {name: run_experiment(d, test, config).first().asDict()  # one row of scores each
            for name, d in (("trtr", train), ("tstr", synth))}
    values = {f"{name}_{k}": v for name, row in rows.items() for k, v in row.items()}
    a, b = rows["trtr"][main], rows["tstr"][main]
    loss = None if a is None or b is None else round(a - b, 4)
    band = "unknown" if loss is None else "ok" if abs(loss) < LOSS_BAND else "degraded"
    schema = ", ".join(f"{k} double" for k in values) + ", loss_metric string, utility_loss double, interpretation string"
    return train.sparkSession.createDataFrame([(*values.values(), main, loss, band)], schema)
