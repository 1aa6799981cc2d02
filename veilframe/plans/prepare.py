"""Raw table → cleaned, minimised, typed, split and profiled table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..operators.clean import MinimizationReport, drop_columns, minimize, preprocess
from ..operators.profile import profile_categorical, profile_continuous, profile_summary
from ..operators.roles import ColumnRoles, detect_column_roles
from ..operators.split import random_split, sample_rows, split_summary, stratified_split
from ..session import materialize

HOLDOUT_RANGE = (0.05, 0.5)


@dataclass(frozen=True)
class PrepareConfig:
    holdout: float = 0.2
    seed: int = 42
    sample_size: int = 0
    exclude: Sequence[str] = field(default_factory=tuple)
    force_categorical: Sequence[str] = field(default_factory=tuple)
    force_continuous: Sequence[str] = field(default_factory=tuple)
    target: str | None = None
    direct_identifiers: Sequence[str] = field(default_factory=tuple)
    drop_high_cardinality: bool = False
    cardinality_threshold: float = 0.9


@dataclass(frozen=True)
class Prepared:
    """The tagged table (column ``split``) with what was learnt on the way."""

    tagged: DataFrame
    roles: ColumnRoles
    minimization: MinimizationReport | None
    config: PrepareConfig

    @property
    def train(self) -> DataFrame:
        return self.tagged.where("split = 'train'").drop("split")

    @property
    def holdout(self) -> DataFrame:
        return self.tagged.where("split = 'holdout'").drop("split")

    def profile(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Header, continuous and categorical profile of the cleaned table before splitting."""
        whole = self.tagged.drop("split")
        return profile_summary(whole, self.roles), profile_continuous(whole, self.roles), profile_categorical(whole, self.roles)

    def summary(self) -> DataFrame:
        return split_summary(self.tagged)


def prepare(df: DataFrame, config: PrepareConfig = PrepareConfig(), order: Column | None = None) -> Prepared:
    """Sample → clean → minimise → find roles → drop excluded columns → split.

    The cleaned table is written out once before it is split, because every later
    step reads it. Minimisation runs if identifiers are given or high-cardinality
    columns are to go. The target is always categorical.
    """
    low, high = HOLDOUT_RANGE
    if not low <= config.holdout <= high:
        raise ValueError(f"holdout must be in [{low}, {high}], got {config.holdout}")
    df = sample_rows(df, config.sample_size, config.seed)
    clean = materialize(preprocess(df), "clean")
    report = None
    if config.direct_identifiers or config.drop_high_cardinality:
        clean, report = minimize(clean, config.direct_identifiers, config.drop_high_cardinality, config.cardinality_threshold)
    forced = [*config.force_categorical, *([config.target] if config.target and config.target not in config.force_categorical else [])]
    roles = detect_column_roles(clean, config.exclude, forced, config.force_continuous)
    kept = drop_columns(clean, config.exclude)
    if config.target and config.target in kept.columns:
        tagged = stratified_split(kept, config.target, config.holdout, config.seed, order)
    else:
        tagged = random_split(kept, config.holdout, config.seed, order)
    return Prepared(materialize(tagged, "split", partition_by="split"), roles, report, config)
