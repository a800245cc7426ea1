"""Choosing and assembling the samples a model is trained or run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.operators.samples import (
    Source,
    common_keys,
    multi_source_samples,
    requested_keys,
    with_predictions,
)

Hook = Callable[[Column], Column]


def sample_table(
    satellite: DataFrame,
    n_before: int,
    n_after: int,
    radar: DataFrame | None = None,
    predict_satellite: bool = False,
    predictions: DataFrame | None = None,
    requested: DataFrame | None = None,
    x_transform: Hook | None = None,
    y_transform: Hook | None = None,
    step: int = 10,
    locations: list[str] | None = None,
    lead_conditioned: bool = False,
) -> DataFrame:
    """Samples from the satellite alone, merged with radar, or with another model's forecasts.

    Merged samples put the radar (one channel) before the satellite (fine and coarse
    channel) and predict the radar, and the satellite too if asked. ``predictions``
    adds that model's forecasts behind the inputs. ``requested`` limits the keys to
    those asked for. The hooks work on the packed values of inputs and targets.

    ``locations`` names the places to use; every table then has a ``location`` column,
    which samples keep and are matched on. ``lead_conditioned`` makes one sample per key
    and lead: its inputs with the ``lead`` asked for, and the target of that lead only.
    """
    by = ["location"] if locations is not None else []

    def placed(df: DataFrame | None) -> DataFrame | None:
        return df if df is None or not by else df.where(F.col("location").isin(locations))

    satellite, radar, predictions, requested = map(
        placed, (satellite, radar, predictions, requested)
    )
    if radar is None:
        sources = [Source(satellite, n_before, n_after)]
    else:
        sources = [
            Source(radar, n_before, n_after, channels=1),
            Source(satellite, n_before, n_after if predict_satellite else 0),
        ]
    keys = common_keys([s.frames for s in sources], by=by)
    if requested is not None:
        keys = requested_keys(requested, keys, by=by)
    keys = keys.select(*by, F.col("frame_ts").alias("key_ts"))
    out = multi_source_samples(sources, step, keys=keys, by=by)
    if predictions is not None:
        first = sum(s.n_before * s.channels for s in sources)
        added = with_predictions(keys, predictions, n_after, step, by=by).select(
            *by,
            "key_ts",
            F.lit("x").alias("kind"),
            F.lit(len(sources)).alias("source"),
            F.col("lead").cast("int").alias("lag"),
            (F.col("lead") - 1 + first).cast("int").alias("channel"),
            "values",
        )
        out = out.unionByName(added)
    for kind, hook in (("x", x_transform), ("y", y_transform)):
        if hook is not None:
            changed = F.when(F.col("kind") == kind, hook(F.col("values")))
            out = out.withColumn("values", changed.otherwise(F.col("values")))
    if lead_conditioned:
        # Inputs go to every lead, a target to its own.
        own = F.when(F.col("kind") == "y", F.array("lag")).otherwise(
            F.sequence(F.lit(1), F.lit(n_after))
        )
        out = out.withColumn("lead", F.explode(own))
    return out
