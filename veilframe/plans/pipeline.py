"""The whole run: prepare, synthesize, score, judge, and try again while it fails."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.clean import align_types
from ..operators.verdict import Thresholds
from ..session import materialize, remove_path, scratch_run
from ..synth.model import Model
from .prepare import Prepared
from .reports import PrivacyConfig, UtilityConfig, final_report, privacy_report, utility_report


@dataclass(frozen=True)
class Outcome:
    synth: DataFrame
    model: Model
    report: DataFrame
    attempts: int


def run(prepared: Prepared, fit: Callable[[DataFrame, int], Model], privacy: PrivacyConfig | None, utility: UtilityConfig | None,
        limits: Thresholds = Thresholds(), n_rows: int | None = None, max_iterations: int = 1, dataset: str = "unknown",
        process_id: str | None = None) -> Outcome:
    """Fit on train, sample, score and judge; while the verdict is FAIL, try again with
    another seed, at most ``max_iterations`` times. The last attempt is returned; the tables of earlier ones are removed.
    Inside ``session.scratch_run`` nothing is left at its end.

    ``fit`` gets the classified train columns and a seed. ``n_rows`` defaults to the train size.
    """
    train, holdout = prepared.train, prepared.holdout
    classified = prepared.roles.restrict(train)
    for attempt in range(1, max(1, max_iterations) + 1):
        with scratch_run(train.sparkSession, remove=False) as tables:
            model = fit(classified, prepared.config.seed + attempt - 1)
            synth = materialize(align_types(model.sample(n_rows, seed=prepared.config.seed + attempt - 1), classified), "synth")
            dp = model.report_frame()
            parts = [None if privacy is None else privacy_report(classified, prepared.roles.restrict(holdout), synth, privacy, dp),
                     None if utility is None else utility_report(classified, synth, prepared.roles.restrict(holdout), utility)]
            parts = [p if p is None else materialize(p, "report") for p in parts]
            minimization = prepared.minimization.to_frame(train.sparkSession) if prepared.minimization else None
            report = materialize(final_report(parts[1], parts[0], dp, limits, minimization, dataset, model.kind, process_id), "final")
        if report.select("verdict.overall").first()[0] != "FAIL":
            break
        if attempt < max_iterations:
            remove_path(train.sparkSession, tables)
    return Outcome(synth, model, report, attempt)
