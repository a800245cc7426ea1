"""Windows over arriving readings, scan alignment and scoring as streams.

Watermarks need zoned timestamps: cast naive ones with :func:`event_time` first.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from pluvia.functions.scalars import clean_score

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# How late each source may arrive, the run cadence and the horizon.
LATENESS = {"rain": "10 minutes", "height": "2 hours"}
CADENCE = "60 minutes"
HORIZON = "3 hours"
# Microseconds of an hour.
HOUR = 3_600_000_000


def event_time(df: DataFrame, ts: str, source: str = "rain") -> DataFrame:
    """Zoned event time with the watermark of its source."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, LATENESS[source])


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None, rocksdb: bool = False):
    """Settings a stream fixes when it starts, restored afterwards.

    A stateful stream keeps the number of state partitions of its first run, so size
    it for the full key space. ``rocksdb`` keeps large state off the heap and is
    needed by ``transformWithState``.
    """
    wanted = {}
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    if rocksdb:
        wanted["spark.sql.streaming.stateStore.providerClass"] = ROCKSDB
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def scheduled(writer: DataStreamWriter, live: bool = False) -> DataStreamWriter:
    """Hourly trigger for a running service, or one pass over what is there."""
    return writer.trigger(processingTime=CADENCE) if live else writer.trigger(availableNow=True)


def tumbling_frames(stream: DataFrame, ts: str, by: list[str], value: str) -> DataFrame:
    """Ten-minute frames: mean and count per window and key."""
    return _windowed(stream, F.window(ts, "10 minutes"), by, value)


def rolling_hours(
    stream: DataFrame, ts: str, by: list[str], value: str, hours: int = 6
) -> DataFrame:
    """The last ``hours`` of data, renewed every hour."""
    return _windowed(stream, F.window(ts, f"{hours} hours", "1 hour"), by, value)


def _windowed(stream: DataFrame, window, by: list[str], value: str) -> DataFrame:
    agg = stream.groupBy(window.alias("w"), *by).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n")
    )
    return agg.select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "mean", "n"
    )


def first_sightings(stream: DataFrame, columns: list[str], ts: str) -> DataFrame:
    """Rows whose ``columns`` were not seen within the watermark.

    ``ts`` carries the watermark; the state holds keys and their expiry only.
    """
    if ts not in stream.columns:
        raise ValueError(f"{ts} must be the watermarked column")
    return stream.dropDuplicatesWithinWatermark(columns)


def latest_height(
    rain: DataFrame, height: DataFrame, ts: str = "ts", height_ts: str = "height_ts",
    back_hours: int = 2,
) -> DataFrame:
    """Latest height scan at or before each rain scan, looking ``back_hours`` at most.

    Both inputs are scan times with watermarks; equal ones count once. Both are kept by the hour: a rain
    scan in its own, a height in its own and in those that may look back to it. When no older height can
    arrive for a rain scan, its hour looks it up among its heights in order, so the work grows with the
    scans and not with their pairs. One without a height within the bound has NULL.
    """
    hour = lambda t: F.floor(F.unix_micros(t) / F.lit(HOUR)).cast("long")
    both = rain.select(F.lit(False).alias("height"), F.col(ts).alias("at")).unionByName(
        height.select(F.lit(True).alias("height"), F.col(height_ts).alias("at"))
    )
    reach = F.when(F.col("height"), F.lit(back_hours)).otherwise(F.lit(0))
    sent = both.where("at is not null").select(
        "height", "at", F.explode(F.sequence(hour("at"), hour("at") + reach)).alias("hour")
    )
    keyed = sent.withColumn("us", F.unix_micros("at"))
    found = keyed.groupBy("hour").transformWithStateInPandas(
        statefulProcessor=LatestHeight(back_hours * HOUR),
        outputStructType="rain long, height long",
        outputMode="Append",
        timeMode="EventTime",
    )
    return found.select(F.timestamp_micros("rain").alias(ts), F.timestamp_micros("height").alias(height_ts))


class LatestHeight(StatefulProcessor):
    """Rain and height scans of one hour, in order; times are microseconds, timers milliseconds.

    Of the heights before the hour only the latest is kept. A timer is set for the earliest rain scan that
    waits and reports all that the watermark has passed; the last one clears the hour.
    """

    def __init__(self, back: int):
        self.back = back

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scans = handle.getValueState("scans", "rain array<long>, heights array<long>")

    def _known(self) -> tuple[np.ndarray, np.ndarray]:
        rain, heights = self.scans.get() if self.scans.exists() else ([], [])
        return np.array(rain, np.int64), np.array(heights, np.int64)

    def _keep(self, key, rain: np.ndarray, heights: np.ndarray) -> None:
        self.scans.update((rain.tolist(), heights.tolist()))
        end = (key[0] + 1) * HOUR + self.back
        due = int(rain[0]) + self.back if len(rain) else end
        self.handle.registerTimer(-(-due // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        rain, heights = self._known()
        for pdf in rows:
            at, is_height = pdf["us"].to_numpy(np.int64), pdf["height"].to_numpy(bool)
            rain = np.union1d(rain, at[~is_height])
            heights = np.union1d(heights, at[is_height])
            earlier = int(np.searchsorted(heights, key[0] * HOUR))
            heights = heights[max(earlier - 1, 0) :]
        self._keep(key, rain, heights)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rain, heights = self._known()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        n = int(np.searchsorted(rain, passed - self.back, "right"))
        if n:
            place = np.searchsorted(heights, rain[:n], "right") - 1
            latest = np.append(heights, np.int64(0))[place]
            none = (place < 0) | (latest < rain[:n] - self.back)
            yield pd.DataFrame({"rain": rain[:n], "height": pd.array(latest, "Int64").copy()}).assign(
                height=lambda d: d["height"].mask(none)
            )
        if n < len(rain):
            self._keep(key, rain[n:], heights)
        elif passed >= (key[0] + 1) * HOUR + self.back:
            self.scans.clear()
        elif n:
            self._keep(key, rain[n:], heights)

    def close(self) -> None:
        pass


def matched_forecasts(
    predictions: DataFrame, frames: DataFrame, by: list[str] | None = None
) -> DataFrame:
    """Forecasts beside the frame observed at their valid time, as frames arrive.

    ``predictions``: ``model, issue_ts, valid_ts, values``, watermark on ``issue_ts``;
    ``frames``: ``frame_ts, observed``, watermark on ``frame_ts``. The horizon bounds
    both states. ``by`` lists the columns, such as the location, that both must share.
    """
    seen = frames.withColumnsRenamed({c: f"_{c}" for c in by or []})
    same = "".join(f"{c} = _{c} AND " for c in by or [])
    matched = predictions.join(
        seen,
        F.expr(
            f"{same}frame_ts = valid_ts AND frame_ts > issue_ts "
            f"AND frame_ts <= issue_ts + INTERVAL {HORIZON}"
        ),
        "inner",
    )
    return matched.drop(*[f"_{c}" for c in by or []])


def frame_scores(matched: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per matched forecast: cells, error sum, and hit and event counts.

    Everything is reduced inside the row, so scoring adds no state; the parts can
    be summed over any group afterwards.
    """
    pairs = F.zip_with(
        "values",
        "observed",
        lambda p, t: F.struct(clean_score(p).alias("p"), clean_score(t).alias("t")),
    )
    df = matched.withColumn("_c", pairs)
    parts = {
        "cells": F.size("_c"),
        "abs_error": F.aggregate(
            "_c", F.lit(0.0), lambda s, c: s + F.abs(c["p"] - c["t"])
        ),
    }
    for k in thresholds:
        parts[f"tp_{k}"] = F.size(F.filter("_c", lambda c: (c["p"] > k) & (c["t"] > k)))
        parts[f"den_{k}"] = F.size(F.filter("_c", lambda c: (c["p"] > k) | (c["t"] > k)))
    return df.select(
        "model", "issue_ts", "valid_ts", *[c.alias(n) for n, c in parts.items()]
    )
