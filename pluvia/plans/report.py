"""The scoring report: every model, every lag, best and worst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.operators.verify import (
    HEADLINE,
    UserMetric,
    best_worst,
    forecast_table,
    hindcast_table,
    issued_at,
    match_forecasts,
    paired_cells,
    score,
    score_frames_by,
)


def score_report(
    predictions: DataFrame,
    truth: DataFrame,
    models: list[str] | None = None,
    metrics: list[str] | None = None,
    keys: list[str] | None = None,
    by: list[str] | None = None,
    issue: Column | None = None,
    user: dict[str, UserMetric] | None = None,
) -> DataFrame:
    """Scores per model and lag with best and worst flags per lag.

    ``predictions``: ``model, lag, valid_ts, values``. One join on the valid time and
    one aggregation cover all lags. With ``models`` every (model, lag) pair is
    reported; a pair that was never forecast has NULL scores. ``by`` columns, such as
    the location, are matched and reported apart. ``issue`` limits the report to the
    forecasts of one issue time (UTC), which it then carries as ``issue_ts``. ``user`` names
    further scores by functions of arrays; they are read from the matched frames, before the cells
    appear, and flagged like the others (lower is better unless their name says CSI or ETS).
    """
    metrics = metrics or HEADLINE
    by = by or []
    group = [*by, "lag"]
    if issue is not None:
        predictions = issued_at(predictions, issue)
        group = ["issue_ts", *group]
    keys = keys or ["model", *group]
    matched = match_forecasts(predictions, truth, "inner", by=by)
    scores = score(paired_cells(matched, keys), keys, metrics)
    if user:
        # One row per group on both sides.
        scores = scores.join(score_frames_by(matched, keys, user), keys, "left")
        metrics = [*metrics, *user]
    if models:
        lags = predictions.select(*group).distinct()
        wanted = lags.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
        scores = wanted.join(scores, keys, "left").select(*scores.columns)
    return best_worst(scores, group, "model", metrics, models)


def comparison_sets(
    predictions: DataFrame, frames: DataFrame, back: int = 18
) -> tuple[DataFrame, DataFrame]:
    """Forecasts from the last frame, and forecasts ``back`` frames old to grade."""
    return forecast_table(predictions, frames), hindcast_table(predictions, frames, back=back)
