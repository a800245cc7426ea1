"""Forecast verification: scores, pooled scores and best/worst models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.arrays import map_values, max_pool
from pluvia.functions.scalars import clean_score, display_dbz
from pluvia.functions.times import caption_time, minutes
from pluvia.operators.ordering import nth_last

# Forecast horizon and the scores of the headline report.
HORIZON = 18
HEADLINE = ["log-MAE", "log-MSE", "CSI1", "CSI8"]

# (forecast, observation) -> aggregate. Both sides are cleaned before scoring.
Metric = Callable[[Column, Column], Column]


def _hits(p: Column, t: Column, threshold: float) -> tuple[Column, Column, Column]:
    forecast, observed = p > threshold, t > threshold
    count = lambda c: F.sum(c.cast("long"))
    return count(forecast & observed), count(forecast), count(observed)


def mse(p: Column, t: Column) -> Column:
    return F.avg((p - t) * (p - t))


def mae(p: Column, t: Column) -> Column:
    return F.avg(F.abs(p - t))


def log_mse(p: Column, t: Column) -> Column:
    d = F.log1p(p) - F.log1p(t)
    return F.avg(d * d)


def log_mae(p: Column, t: Column) -> Column:
    return F.avg(F.abs(F.log1p(p) - F.log1p(t)))


def csi(threshold: float) -> Metric:
    """Hits over all cells where an event was forecast or observed."""

    def build(p: Column, t: Column) -> Column:
        hit, forecast, observed = _hits(p, t, threshold)
        return F.try_divide(hit, forecast + observed - hit)

    return build


def ets(threshold: float) -> Metric:
    """CSI corrected for the hits expected by chance."""

    def build(p: Column, t: Column) -> Column:
        hit, forecast, observed = _hits(p, t, threshold)
        chance = F.try_divide(forecast.cast("double") * observed, F.count(p))
        return F.try_divide(hit - chance, forecast + observed - hit - chance)

    return build


METRICS: dict[str, Metric] = {
    "MSE": mse,
    "MAE": mae,
    "log-MSE": log_mse,
    "log-MAE": log_mae,
    **{f"CSI{k}": csi(k) for k in (1, 2, 4, 8, 16)},
    **{f"ETS{k}": ets(k) for k in (1, 2, 4, 8)},
}


def lower_is_better(metric: str) -> bool:
    return not metric.startswith(("CSI", "ETS"))


def match_forecasts(
    predictions: DataFrame,
    truth: DataFrame,
    how: str = "left",
    valid: str = "valid_ts",
    observed: str = "frame_ts",
    forecast_values: str = "values",
    observed_values: str = "values",
    by: list[str] | None = None,
) -> DataFrame:
    """Every packed forecast beside the packed frame observed at its valid time.

    One row per forecast: the cells travel inside the rows, so the join shuffles
    frames and not cells. ``how='left'`` keeps forecasts without an observation. ``by``
    lists the columns, such as the location, that both must share.
    """
    on = [*(by or []), valid]
    t = truth.select(
        *(by or []), F.col(observed).alias(valid), F.col(observed_values).alias("truth")
    )
    return predictions.withColumnRenamed(forecast_values, "forecast").join(t, on, how)


def paired_cells(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Cleaned (forecast, truth) cells of matched frames; the observation drives the cells."""
    forecast = F.coalesce("forecast", F.array().cast(matched.schema["forecast"].dataType))
    both = F.arrays_zip(forecast.alias("p"), F.col("truth").alias("t"))
    # The cells travel as pairs of numbers, not beside the whole arrays.
    cells = matched.select(
        *keys, F.col("forecast").isNotNull().alias("_has"), F.size("truth").alias("_n"),
        F.posexplode(both).alias("cell", "_c"),
    ).where(F.col("cell") < F.col("_n"))
    return cells.select(
        *keys,
        "cell",
        F.when(F.col("_has"), clean_score(F.col("_c.p"))).alias("p"),
        clean_score(F.col("_c.t")).alias("t"),
    )


def score(
    pairs: DataFrame, by: list[str], metrics: list[str] | dict[str, Metric] | None = None
) -> DataFrame:
    """All scores in one aggregation over cleaned cells ``p`` (forecast) and ``t`` (truth).

    ``metrics`` is a list of registered names or a mapping of user metrics.
    """
    chosen = METRICS if metrics is None else metrics
    if not isinstance(chosen, dict):
        chosen = {m: METRICS[m] for m in chosen}
    p, t = F.col("p"), F.col("t")
    return pairs.groupBy(*by).agg(*[build(p, t).alias(m) for m, build in chosen.items()])


@dataclass(frozen=True)
class UserMetric:
    """A score by a function of arrays, as sums that frames add up.

    ``partial`` gets the cells of one forecast and of its observation, cleaned like those of all scores,
    and returns ``parts`` numbers; ``finish`` makes the score from the columns of their sums. So the
    function sees one frame at a time, in Arrow batches, and a group of any size is only a sum.
    """

    partial: Callable[[np.ndarray, np.ndarray], Sequence[float]]
    parts: int
    finish: Callable[..., Column]


def _frame_parts(metrics: dict[str, UserMetric]):
    """Arrow function: partial sums of all metrics of packed pairs, one list per pair."""
    count = sum(m.parts for m in metrics.values())

    @F.arrow_udf("array<double>")
    def run(forecast: pa.Array, truth: pa.Array) -> pa.Array:
        out = []
        for k in range(len(truth)):
            if not (forecast[k].is_valid and truth[k].is_valid):
                out.append(np.zeros(count))
                continue
            p, t = (np.asarray(a[k].values.to_numpy(zero_copy_only=False), np.float64) for a in (forecast, truth))
            sums = [np.asarray(m.partial(p, t), np.float64) for m in metrics.values()]
            if [len(s) for s in sums] != [m.parts for m in metrics.values()]:
                raise ValueError("a user metric gave another number of parts than it states")
            out.append(np.concatenate(sums))
        ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * count)
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0), *out])))

    return run


def score_frames_by(matched: DataFrame, by: list[str], metrics: dict[str, UserMetric]) -> DataFrame:
    """User metrics of matched frames (:func:`match_forecasts`) per group.

    Cells beyond the observation are left out, like those of :func:`paired_cells`.
    """
    n = F.size("truth")
    short = F.array_repeat(F.lit(None).cast("double"), F.greatest(n - F.size("forecast"), F.lit(0)))
    p = F.concat(F.slice("forecast", F.lit(1), n), short)
    cleaned = [F.transform(c, clean_score) for c in (p, F.col("truth"))]
    sums = matched.select(*by, _frame_parts(metrics)(*cleaned).alias("_s"))
    count = sum(m.parts for m in metrics.values())
    parts = sums.groupBy(*by).agg(*[F.sum(F.get("_s", F.lit(k))).alias(f"_s{k}") for k in range(count)])
    out, first = [], 0
    for name, m in metrics.items():
        out.append(m.finish(*[F.col(f"_s{first + k}") for k in range(m.parts)]).alias(name))
        first += m.parts
    return parts.select(*by, *out)


def csi_parts(pairs: DataFrame, by: list[str], thresholds: list[float]) -> DataFrame:
    """Hit and event counts per threshold: the parts that may be summed across groups."""
    aggs = []
    for k in thresholds:
        hit, forecast, observed = _hits(F.col("p"), F.col("t"), k)
        aggs += [hit.alias(f"tp_{k}"), (forecast + observed - hit).alias(f"den_{k}")]
    return pairs.groupBy(*by).agg(*aggs)


def pooled_csi(
    pairs: DataFrame, dims: list[str], thresholds: list[float], how: str = "rollup"
) -> DataFrame:
    """CSI per group and pooled over coarser groups: parts are summed, then divided.

    The cells are reduced once to one row per finest group; the rollup runs over
    that small table.
    """
    parts = csi_parts(pairs, dims, thresholds)
    grouped = parts.rollup(*dims) if how == "rollup" else parts.cube(*dims)
    aggs = [
        F.try_divide(F.sum(f"tp_{k}"), F.sum(f"den_{k}")).alias(f"csi_{k}") for k in thresholds
    ]
    return grouped.agg(*aggs)


def neighbourhood_pairs(
    matched: DataFrame, keys: list[str], ni: int, nj: int, kernel: int = 5, stride: int = 2
) -> DataFrame:
    """Like :func:`paired_cells` after max-pooling both frames inside their rows."""
    sides = ("forecast", "truth")
    clean = matched.withColumns({c: map_values(F.col(c), clean_score) for c in sides})
    pooled = clean.withColumns({c: max_pool(F.col(c), ni, nj, kernel, stride) for c in sides})
    return paired_cells(pooled, keys)


def to_long(scores: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """One row per group and metric, with the metric's registry position."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("score"))
                for m in metrics
            ]
        )
    )
    return scores.select(*by, cells.alias("_m")).select(*by, "_m.metric", "_m.score")


def rank_models(
    scores: DataFrame, by: list[str], model: str, metrics: list[str]
) -> DataFrame:
    """Rank of every model within its group for each metric, 1 is best."""
    long = to_long(scores, [*by, model], metrics)
    signed = F.when(
        F.col("metric").isin([m for m in metrics if lower_is_better(m)]), F.col("score")
    ).otherwise(-F.col("score"))
    w = Window.partitionBy(*by, "metric").orderBy(signed.asc_nulls_last())
    return long.withColumn("rank", F.when(F.col("score").isNotNull(), F.rank().over(w)))


def best_worst(
    scores: DataFrame,
    by: list[str],
    model: str,
    metrics: list[str],
    order: list[str] | None = None,
) -> DataFrame:
    """Scores with a best and a worst flag per metric.

    Missing scores are ignored; a metric that is missing for every model has NULL
    flags. Equal models: the first in ``order`` (else by name) takes the flag.
    """
    if order:
        place = F.element_at(
            F.create_map(*[x for n, m in enumerate(order) for x in (F.lit(m), F.lit(n))]),
            F.col(model),
        )
    else:
        place = F.col(model)
    # A worst model is the first of those with the largest signed score, so the two
    # rankings differ in direction of the score only.
    group = Window.partitionBy(*by)
    flags = []
    for kind in ("worst", "best"):
        for m in metrics:
            v = F.col(f"`{m}`")
            signed = v if lower_is_better(m) == (kind == "best") else -v
            key = F.when(v.isNotNull(), F.struct(signed.alias("s"), place.alias("p")))
            pick = F.min_by(F.col(model), key).over(group)
            flags.append((pick == F.col(model)).alias(f"{kind}_{m}"))
    return scores.select(*[F.col(f"`{c}`") for c in scores.columns], *flags)


def comparison_issue(frames: DataFrame, ts: str = "frame_ts", back: int = HORIZON) -> DataFrame:
    """Issue time whose whole horizon has been observed: ``back`` frames before the last."""
    return nth_last(frames, ts, back + 1)


def forecast_table(
    predictions: DataFrame, frames: DataFrame, ts: str = "frame_ts"
) -> DataFrame:
    """Forecasts issued at the last observed frame: the next-hours display set."""
    return issued_at(predictions, frames.agg(F.max(ts)).scalar())


def issued_at(predictions: DataFrame, issue: Column) -> DataFrame:
    """Forecasts of one issue; a table partitioned by ``issue_date`` is read at that date only."""
    found = predictions.where(F.col("issue_ts") == issue)
    if "issue_date" in predictions.columns:
        found = found.where(F.col("issue_date") == issue.cast("date"))
    return found


def hindcast_table(
    predictions: DataFrame, frames: DataFrame, ts: str = "frame_ts", back: int = HORIZON
) -> DataFrame:
    """Forecasts issued ``back`` frames ago, to compare with what followed."""
    return issued_at(predictions, comparison_issue(frames, ts, back).select(ts).scalar())


def marker_table(cells: DataFrame, feature: str) -> DataFrame:
    """Cells worth drawing: at least 10 dBZ for reflectivity, 0.5 mm/h for rain rate."""
    if feature == "DBZH":
        shown = cells.withColumn("value", display_dbz(F.col("value")))
        return shown.where(F.col("value") >= 10)
    return cells.where((F.col("value") >= 0.5) & ~F.isnan("value"))


def with_captions(df: DataFrame, step: int = 10) -> DataFrame:
    """Clock captions of issue and valid time from ``issue_ts`` and ``lag``."""
    return df.withColumns(
        {
            "issue_caption": caption_time(F.col("issue_ts")),
            "valid_caption": caption_time(F.col("issue_ts") + minutes(F.col("lag") * step)),
        }
    )
