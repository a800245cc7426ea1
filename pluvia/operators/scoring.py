"""Running a user's model over packed samples, in parallel and in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions.arrays import map_values
from pluvia.functions.scalars import clamp_negative, denormalise, normalise
from pluvia.functions.times import minutes

# Fixed value: samples per model call.
BATCH = 8

# (batch, n_before, ni, nj) -> (batch, n_after, ni, nj)
Model = Callable[[np.ndarray], np.ndarray]


def stack_inputs(
    past: DataFrame, ni: int, nj: int, key: str = "key_ts", by: list[str] | None = None
) -> DataFrame:
    """One row per sample with its past frames newest first; missing frames are zeros.

    A group holds ``n_before`` frames of one key (and location, if ``by`` names it).
    """
    blank = F.array_repeat(F.lit(0.0), ni * nj)
    frames = F.array_sort(F.collect_list(F.struct("lag", F.coalesce("values", blank).alias("v"))))
    return past.groupBy(*(by or []), key).agg(F.flatten(F.transform(frames, lambda f: f["v"])).alias("x"))


def score_frames(
    samples: DataFrame,
    model: Model,
    name: str,
    n_before: int,
    n_after: int,
    ni: int,
    nj: int,
    step: int = 10,
    transform: int | None = None,
    mean: float = 0.0,
    std: float = 1.0,
    batch: int = BATCH,
    key: str = "key_ts",
    by: list[str] | None = None,
) -> DataFrame:
    """Predictions ``(model, by, issue_ts, valid_ts, lead, values)`` of a user model.

    ``transform`` selects the input normalisation and its inverse. Forecasts are
    clamped at zero before the inverse. Samples are scored where they are: there is
    no shuffle, and a task holds one Arrow batch at a time.
    """
    by = by or []
    x = F.col("x")
    if transform is not None:
        x = map_values(x, lambda v: normalise(v, transform, mean, std))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                stack = np.stack(part["x"].to_numpy()).reshape(-1, n_before, ni, nj)
                y = np.asarray(model(stack)).reshape(len(part), n_after, ni * nj)
                yield pd.DataFrame(
                    {
                        **{c: np.repeat(part[c].to_numpy(), n_after) for c in by},
                        key: np.repeat(part[key].to_numpy(), n_after),
                        "lead": np.tile(np.arange(1, n_after + 1, dtype="int32"), len(part)),
                        "values": list(y.reshape(-1, ni * nj).astype(float)),
                    }
                )

    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in [*by, key])
    raw = samples.select(*by, key, x.alias("x")).mapInPandas(
        run, f"{kinds}, lead int, values array<double>"
    )
    values = map_values(F.col("values"), clamp_negative)
    if transform is not None:
        values = map_values(values, lambda v: denormalise(v, transform, mean, std))
    return raw.select(
        F.lit(name).alias("model"),
        *by,
        F.col(key).alias("issue_ts"),
        (F.col(key) + minutes(F.col("lead") * step)).alias("valid_ts"),
        "lead",
        values.alias("values"),
    )
