"""Past/future sample windows, multi-source samples and sample weights.

Frames are packed (one row per source and time). Sample assembly joins on time
keys only; no cell-level shuffle takes place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.scalars import sample_mass
from pluvia.functions.times import date_features, minutes
from pluvia.session import join_dimension

# Fixed value: weight every sample gets before normalisation.
MIN_WEIGHT = 100.0
LATENT_PAST = 10


def expand_past(keys: DataFrame, n_before: int, step: int = 10, key: str = "key_ts") -> DataFrame:
    """Each key with its past times; lag 0 is the key itself."""
    out = keys.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(n_before - 1))))
    return out.withColumn("need_ts", F.col(key) - minutes(F.col("lag") * step))


def expand_future(keys: DataFrame, n_after: int, step: int = 10, key: str = "key_ts") -> DataFrame:
    """Each key with its future times; lead 1 is the next step."""
    out = keys.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(n_after))))
    return out.withColumn("need_ts", F.col(key) + minutes(F.col("lead") * step))


def _fetch(wanted: DataFrame, frames: DataFrame, ts: str, values: str, on: list[str]) -> DataFrame:
    got = frames.select(*on, F.col(ts).alias("need_ts"), F.col(values).alias("values"))
    return wanted.join(got, [*on, "need_ts"], "left")


def past_frames(
    keys: DataFrame,
    frames: DataFrame,
    n_before: int,
    step: int = 10,
    key: str = "key_ts",
    ts: str = "frame_ts",
    values: str = "values",
    on: list[str] | None = None,
) -> DataFrame:
    """Past frames of every key, newest first (lag 0); a missing frame has NULL values."""
    return _fetch(expand_past(keys, n_before, step, key), frames, ts, values, on or [])


def future_frames(
    keys: DataFrame,
    frames: DataFrame,
    n_after: int,
    step: int = 10,
    key: str = "key_ts",
    ts: str = "frame_ts",
    values: str = "values",
    on: list[str] | None = None,
) -> DataFrame:
    """Future frames of every key (lead 1 first); a missing frame has NULL values."""
    return _fetch(expand_future(keys, n_after, step, key), frames, ts, values, on or [])


def bucketed_samples(
    spark: SparkSession, name: str, n_before: int, n_after: int, step: int = 10, ts: str = "frame_ts"
) -> DataFrame:
    """Past and future frames of every frame of a bucketed table, without a shuffle.

    ``source, location, key_ts, lag, values``: lag 0 is the key, positive lags are earlier and negative
    ones later; a missing frame has NULL values. The table holds all that a key needs in the key's own
    bucket (:func:`pluvia.sources.sinks.write_frame_buckets`, with at least this horizon). Joining by more
    columns than the buckets have needs the setting this switches on.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    table = spark.table(name)
    place = ["source", "location", "slot"]
    lag = F.explode(F.sequence(F.lit(-n_after), F.lit(n_before - 1))).alias("lag")
    keys = table.where("own").select(*place, F.col(ts).alias("key_ts"), lag)
    wanted = keys.withColumn("need_ts", F.col("key_ts") - minutes(F.col("lag") * step))
    got = _fetch(wanted, table, ts, "values", place)
    return got.select("source", "location", "key_ts", "lag", "values")


def lead_pairs(
    keys: DataFrame,
    frames: DataFrame,
    n_after: int,
    step: int = 10,
    key: str = "key_ts",
    ts: str = "frame_ts",
    values: str = "values",
    on: list[str] | None = None,
) -> DataFrame:
    """One row per key and lead with the frame before the lead and the frame at it.

    If either frame is missing, both are NULL. ``on`` lists the columns, such as the
    location, that keys and frames must share besides the time. Frames meet their successors
    once, by time; the keys' leads then join these pairs where they lie, so a frame moves
    twice whatever the number of leads, and repeated keys keep their rows.
    """
    on = on or []
    known = frames.where(F.col(values).isNotNull())
    target = known.select(*on, F.col(ts).alias("need_ts"), F.col(values).alias("target"))
    previous = known.select(
        *on, (F.col(ts) + minutes(step)).alias("need_ts"), F.col(values).alias("previous")
    )
    pairs = target.join(previous, [*on, "need_ts"], "inner")
    wanted = expand_future(keys, n_after, step, key)
    return wanted.join(pairs, [*on, "need_ts"], "left").select(
        *keys.columns, "lead", "previous", "target"
    )


def valid_keys(
    times: DataFrame,
    n_before: int,
    n_after: int,
    step: int = 10,
    ts: str = "frame_ts",
    by: list[str] | None = None,
    latent: bool = False,
) -> DataFrame:
    """Times usable as sample keys.

    At most ``n_before // 3`` past frames may be missing and no future frame may.
    ``latent`` widens the past horizon (not the allowance) to 10 frames.

    Every existing time votes for the keys whose window it falls in; a key is
    valid when its votes suffice. Counting votes needs one shuffle and no
    ordering, and it compares exact times, so off-step times never count.
    """
    by = by or []
    horizon = max(n_before, LATENT_PAST) if latent and n_before < LATENT_PAST else n_before
    span = F.sequence(F.lit(-n_after), F.lit(horizon - 1))
    votes = times.select(*by, ts).distinct().select(
        *by, F.col(ts).alias("_at"), F.explode(span).alias("_off")
    )
    votes = votes.select(*by, (F.col("_at") + minutes(F.col("_off") * step)).alias(ts), "_off")
    counted = votes.groupBy(*by, ts).agg(
        F.count(F.when(F.col("_off") >= 0, 1)).alias("_past"),
        F.count(F.when(F.col("_off") < 0, 1)).alias("_future"),
        F.count(F.when(F.col("_off") == 0, 1)).alias("_self"),
    )
    good = (
        (F.col("_self") > 0)
        & (F.lit(horizon) - F.col("_past") <= n_before // 3)
        & (F.col("_future") == n_after)
    )
    return counted.where(good).select(*by, ts)


def requested_keys(
    requested: DataFrame, frames: DataFrame, ts: str = "frame_ts", by: list[str] | None = None
) -> DataFrame:
    """Requested times (of each ``by``, such as the location) that have a frame."""
    on = [*(by or []), ts]
    return requested.join(frames.select(*on).distinct(), on, "left_semi")


def common_keys(
    sources: list[DataFrame], ts: str = "frame_ts", by: list[str] | None = None
) -> DataFrame:
    """Times (of each ``by``, such as the location) present in every source."""
    on = [*(by or []), ts]
    keys = sources[0].select(*on).distinct()
    for other in sources[1:]:
        keys = keys.intersect(other.select(*on))
    return keys


@dataclass(frozen=True)
class Source:
    """One input of a multi-source sample: its frames and how much of them to use."""

    frames: DataFrame
    n_before: int
    n_after: int
    channels: int = 2


def multi_source_samples(
    sources: list[Source],
    step: int = 10,
    ts: str = "frame_ts",
    keys: DataFrame | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Input and target frames of every key common to all sources.

    Output rows: ``key_ts, kind ('x'|'y'), source, lag, channel, values`` where
    ``channel`` is the first channel the frame takes in the stacked sample. Each
    source fills its own range, newest frame first for inputs. ``keys`` (``by, key_ts``)
    replaces the common keys. ``by`` columns, such as the location, lead the output and
    keys and frames must share them. A source is joined once for inputs and targets.
    """
    by = by or []
    if keys is None:
        keys = common_keys([s.frames for s in sources], ts, by)
        keys = keys.select(*by, F.col(ts).alias("key_ts"))
    parts, x0, y0 = [], 0, 0
    for n, s in enumerate(sources):
        if s.n_before or s.n_after:
            # Step 0 is the key's own frame: the newest input, lag 0.
            steps = F.sequence(F.lit(1 - s.n_before), F.lit(s.n_after))
            wanted = keys.select(*by, "key_ts", F.explode(steps).alias("_step"))
            at = F.col("key_ts") + minutes(F.col("_step") * step)
            got = _fetch(wanted.withColumn("need_ts", at), s.frames, ts, "values", by)
            future = F.col("_step") > 0
            lag = F.when(future, F.col("_step")).otherwise(-F.col("_step"))
            channel = F.when(future, y0 + (F.col("_step") - 1) * s.channels).otherwise(
                x0 - F.col("_step") * s.channels
            )
            kind = F.when(future, "y").otherwise("x")
            parts.append(_stack(got, by, kind, n, lag, channel))
        x0 += s.n_before * s.channels
        y0 += s.n_after * s.channels
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _stack(
    df: DataFrame, by: list[str], kind: Column, source: int, lag: Column, channel: Column
) -> DataFrame:
    return df.select(
        *by,
        "key_ts",
        kind.alias("kind"),
        F.lit(source).alias("source"),
        lag.cast("int").alias("lag"),
        channel.cast("int").alias("channel"),
        "values",
    )


def with_predictions(
    keys: DataFrame,
    predictions: DataFrame,
    n_after: int,
    step: int = 10,
    key: str = "key_ts",
    by: list[str] | None = None,
) -> DataFrame:
    """Another model's forecasts for every key and lead. A missing one is an error.

    ``by`` lists the columns, such as the location, that both must share. The error is raised while the join runs, so no separate check reads the data.
    """
    wanted = expand_future(keys, n_after, step, key).withColumnRenamed("need_ts", "valid_ts")
    by = by or []
    got = predictions.select(
        *by, F.col("issue_ts").alias(key), "valid_ts", "values", F.lit(True).alias("_found")
    )
    joined = wanted.join(got, [*by, key, "valid_ts"], "left")
    values = F.when(F.col("_found"), F.col("values")).otherwise(
        F.raise_error(
            F.concat_ws(" ", F.lit("no prediction for"), F.col(key).cast("string"),
                        F.col("valid_ts").cast("string"))
        ).cast(predictions.schema["values"].dataType)
    )
    return joined.select(*keys.columns, "lead", "valid_ts", values.alias("values"))


def with_static(cells: DataFrame, grid: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Elevation and position of every cell from the grid dimension."""
    return join_dimension(cells, grid, on or ["location", "i", "j"], "left")


def with_date_features(samples: DataFrame, key: str = "key_ts") -> DataFrame:
    return samples.withColumns(date_features(F.col(key)))


def lead_expansion(keys: DataFrame, n_after: int) -> DataFrame:
    """Every sample once per lead index 0..n_after-1."""
    return keys.withColumn("lead", F.explode(F.sequence(F.lit(0), F.lit(n_after - 1))))


def select_channels(
    samples: DataFrame,
    n_before: int,
    elevation: bool = False,
    lat_lon: bool = False,
    hour: bool = False,
    context: bool = True,
    satellite: bool = True,
    target_context: bool = False,
) -> DataFrame:
    """Keep the sample channels a model asks for.

    Rows carry ``kind`` ('x', 'y', 'meta'), ``ch`` (0 fine, 1 coarse), ``feature``
    for metadata ('elevation', 'lat_lon', 'hour') and ``src`` ('satellite' or
    'radar').
    """
    x = (F.col("kind") == "x") & (F.col("lag") < n_before)
    if not context:
        x = x & (F.col("ch") == 0)
    if not satellite:
        x = x & (F.col("src") != "satellite")
    y = F.col("kind") == "y"
    if not target_context:
        y = y & (F.col("ch") == 0)
    flags = {"elevation": elevation, "lat_lon": lat_lon, "hour": hour}
    features = [f for f, on in flags.items() if on]
    meta = (F.col("kind") == "meta") & F.col("feature").isin(features or ["-"])
    return samples.where(x | y | meta)


def frame_mass(frames: DataFrame, values: str = "values") -> DataFrame:
    """Frames with ``values`` replaced by the one number that weights need: their rain mass."""
    mass = F.aggregate(
        F.coalesce(F.col(values), F.array().cast("array<double>")),
        F.lit(0.0),
        lambda s, v: s + sample_mass(v),
    )
    return frames.withColumn(values, mass)


def sample_weights(
    samples: DataFrame, key: str = "key_ts", values: str = "values", minimum: float = MIN_WEIGHT
) -> DataFrame:
    """Normalised weight per key from the rain in its input and target frames.

    ``samples`` hold the frames, or better their masses: samples joined from
    :func:`frame_mass` move one number per frame. The total is one row.
    """
    if samples.schema[values].dataType.simpleString().startswith("array"):
        samples = frame_mass(samples, values)
    mass = F.coalesce(F.col(values), F.lit(0.0))
    raw = samples.select(key, mass.alias("_mass")).groupBy(key).agg(
        (F.sum("_mass") + minimum).alias("raw_weight")
    )
    total = raw.agg(F.sum("raw_weight")).scalar()
    return raw.withColumn("weight", F.col("raw_weight") / total)


def rolling_weights(
    weights: DataFrame, n_before: int, n_after: int, idx: str = "idx", min_sum: float = 0.0
) -> DataFrame:
    """Sum of frame weights over positions ``-(n_before-1)..n_after`` around each frame.

    Positions outside the dataset count as the smallest weight. Sums are shifted
    so that none is negative, then normalised. Every frame adds its weight to the
    positions that see it, so no window over the whole axis is needed.
    """
    span = n_before + n_after
    offs = F.sequence(F.lit(-n_after), F.lit(n_before - 1))
    sent = weights.select(F.col(idx).alias("_i"), "weight", F.explode(offs).alias("_off"))
    sums = sent.groupBy((F.col("_i") + F.col("_off")).alias(idx)).agg(
        F.sum("weight").alias("_s"),
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(F.col("_off") == 0, F.col("weight"))).alias("_own"),
    )
    known = sums.where(F.col("_own").isNotNull())
    # All that the shift needs, by the number of positions inside the dataset: few rows.
    groups = known.groupBy("_n").agg(
        F.min("_s").alias("least"), F.sum("_s").alias("sum"), F.count(F.lit(1)).alias("count"),
        F.min("_own").alias("own"),
    )
    one = groups.agg(
        F.collect_list(F.struct("_n", "least", "sum", "count")).alias("g"), F.min("own").alias("low")
    )
    low = F.col("low")
    outside = lambda g: (F.lit(span) - g["_n"]) * low
    least = F.array_min(F.transform("g", lambda g: g["least"] + outside(g)))
    lift = F.greatest(F.lit(float(min_sum)), -least)
    total = F.aggregate(
        "g", F.lit(0.0), lambda t, g: t + g["sum"] + g["count"] * outside(g)
    )
    count = F.aggregate("g", F.lit(0).cast("long"), lambda t, g: t + g["count"])
    stats = one.select(
        F.struct(low.alias("low"), lift.alias("lift"), (total + count * lift).alias("total"))
    ).scalar()
    filled = known.select(
        idx, (F.col("_s") + (F.lit(span) - F.col("_n")) * stats["low"]).alias("sum_weight")
    )
    return filled.withColumn(
        "weight", (F.col("sum_weight") + stats["lift"]) / stats["total"]
    )


def lead_decay(weights: DataFrame, n_after: int, weight: str = "weight") -> DataFrame:
    """Weights per lead index, falling to a quarter over the horizon."""
    rate = math.log(4) / n_after
    out = lead_expansion(weights, n_after)
    return out.withColumn(weight, F.col(weight) * F.exp(F.col("lead") * F.lit(-rate)))
